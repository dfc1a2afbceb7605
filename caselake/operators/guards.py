"""Guards of request texts: attempts to steer, flags that need a person, requests for a person's record.

Patterns are tried on views of a text (plain, letters joined, figures read as letters, both), each view that
equals the plain one only once, all patterns of a kind in one pass. Requests for a record are judged sentence by
sentence in an array, and count only where the masked text still points at somebody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.surrogate import table
from .hygiene import fold_leet, normalize_text
from .masking import U, mask_pii
from .names import AMBIGUOUS, CAP, FIRST_NAMES, NO_NAMES
from .views import collapse_letters, iso_effective_dates

# Patterns of guards, which must find the same texts.
INJECTION = (
    r"\b(?:ignore|disregard|override)\b[^.?!]{0,30}\b(?:previous|prior|above|earlier|all|your)\b[^.?!]{0,30}\b(?:instructions?|rules?|polic(?:y|ies)|guidelines?)\b",
    r"\bdisregard\s+(?:everything|all)\b",
    r"\bforget\b[^.?!]{0,20}\b(?:polic(?:y|ies)|rules?|instructions?)\b",
    r"\bnew\s+instructions?\b",
    r"\b(?:no|without|any)\s+restrictions?\b",
    r"\boverrid(?:e|es|ing)\b",
    r"\bpretend\b",
    r"\bbypass\w*\b",
    r"\bapprove\b[^.?!]{0,20}\bCASE-\d+",
    r"\bi(?: am|'m) (?:the |an? )?(?:admin|administrator|root|superuser|sysadmin|developer)\b",
    r"\byou are now\b",
    r"\bsystem prompt\b",
    r"\bdeveloper mode\b",
    r"\bjailbreak\w*\b",
    r"\bdisable (?:your )?(?:rules|guardrails|safety|filters)\b",
    r"\bact as\b[^.?!]{0,30}\b(?:admin|root|unrestricted)\b",
    r"<\s*/?\s*(?:system|assistant|developer|instructions?|im_start|im_end)\b[^>]*>",
    r"<\|\s*(?:im_start|im_end|system)\s*\|>",
    r"\[\s*/?\s*(?:system|inst|instructions?)\s*\]",
    r"(?:^|\n)\s*#{2,}\s*(?:system|instructions?)\b",
    r"\b(?:approved|approve|auto_?approve|override|decision|status|state)\s*=\s*[\"']?(?:true|1|yes|closed|approved|done|complete\w*)\b",
    r"[\"'](?:approved|status|decision|override)[\"']\s*:\s*[\"']?(?:true|1|yes|closed|approved|done)\b",
    r"\b(?:do not|don't|dont|never|stop)\s+(?:follow\w*|obey\w*|apply\w*|us(?:e|ing)|respect\w*)\s+(?:your|the|any|these)\s+(?:rules|instructions|guidelines|polic\w+)\b",
    r"\b(?:reveal|show|print|display|translate|repeat|output|tell me|give me|leak)\b[^.?!]{0,25}\b(?:your|the)\s+(?:system|hidden|initial|original|secret|internal)\s+(?:prompt|instructions?|message|rules)\b",
)
SYMPTOMS = (r"pains?|aches?|aching|lumps?|bleed\w*|fever\w*|rash(?:es)?|swell\w*|swollen|dizz\w*|breathless\w*|short of breath|chest|"
            r"nausea\w*|vomit\w*|cough\w*|faint\w*|numb(?:ness|ing|ed)?|seizure\w*|cramp\w*|headache\w*|migraine\w*|infect\w*|wounds?|fractur\w*|"
            r"injur\w*|bruis\w*|itch\w*|sore throat|diarrh\w*|palpitation\w*|fatigue|tumou?rs?|cancer\w*|diabet\w*|asthma\w*|"
            r"hypertension|blood pressure|heart\w*|stroke|allerg\w*|pregnan\w*|depress\w*|anxiety|suicid\w*|symptoms?|diagnos\w*|"
            r"treatments?|surgery|surgical|overdos\w*|side effects?")
DRUGS = (r"insulin|ibuprofen|aspirin|paracetamol|acetaminophen|warfarin|metformin|antibiotics?|amoxicillin|statins?|opioids?|"
         r"morphine|codeine|steroids?|antidepressants?|xanax|prozac|lisinopril|atorvastatin|omeprazole|tylenol|advil|"
         r"blood thinners?|painkillers?|antihistamines?|vitamins?")
MEDICINES = r"medications?|meds?|medicines?|pills?|tablets?|capsules?|drugs?|doses?|dosage|dosing|prescribe\w*|" + DRUGS
DRINKS = r"alcohol|drink\w*|beer|wine|liquor"
CLINICAL = (
    rf"\b(?:{SYMPTOMS}|{MEDICINES})\b",
    r"(?<![A-Za-z])mg\b(?!\s+(?:road|rd|street|st|lane|avenue)\b)",
    r"\bshould (?:i|he|she|they|we|the patient|my \w+)\b[^.?!]{0,30}\b(?:take|stop|skip|start|use|mix|combine|continue|increase|reduce|double)\b",
    r"\bsafe (?:to|for) (?:mix|combine|take|stop|use|skip|continue|him|her|them|the patient)\b",
    r"\bis it (?:okay|ok|fine|safe|alright) (?:to (?:take|stop|skip|mix|combine|use|drink|eat|give|continue|start|double)|for (?:him|her|them|me|the patient|a patient|my \w+))\b",
    rf"\b(?:{DRINKS})\b[^.?!]{{0,40}}\b(?:{MEDICINES})\b",
    rf"\b(?:{MEDICINES})\b[^.?!]{{0,40}}\b(?:{DRINKS})\b",
    r"\bkeep taking\b",
    r"\bstop taking\b",
    r"\bdouble .{0,20}dose",
)
SENSITIVE = (r"complain\w*|grievance|\blawyers?\b|\battorney\b|\bsolicitor\b|\blegal\b|\bcourt\b|\bsue\b|\bsuing\b|\blawsuit\b|ombudsman|"
             r"harass\w*|discriminat\w*|\bfraud\w*|privacy breach|\bdistress\w*|"
             r"\bregulators?\b|\breport (?:this|it|you|them) to\b|\bconsumer court\b|\bpress release\b|\bsocial media\b|\bthe (?:media|press)\b|"
             r"\b(?:to|contact|call|tell|alert|inform|involve|leak\w*)\s+(?:the\s+)?(?:media|press|newspapers?|journalists?|reporters?)\b")
LEGAL = r"\blawyers?\b|\blegal\b|\bcourt\b|\battorney\b|\bsolicitor\b|\bsue\b|\bsuing\b|\blawsuit\b|\bregulators?\b|\bombudsman\b"
ASKING = r"(?:show|tell|give|share|reveal|read|display|provide|send|list|look up|what(?:'s| is| are)|get)"
ASKING_WEAK = r"(?:what does|what do|say|says|check|view|pull up|look at|lookup)"
ATTRIBUTE = r"(?:phone|e-?mail|home address|address|dob|date of birth|birth ?date|details|balance|plan|amounts?|ssn)"
SUBJECT = r"(?:member|patient|M[- ]?\d{5,12}|PA-[\d-]+|Dr\.?\s+[A-Z]\w+|(?:Ms|Mr|Mrs)\.?\s+[A-Z]\w+|CLM-\d+|INV-\d+|invoice|claim)"
ATTRIBUTE_BARE = r"(?i)\b(?:phone|e-?mail|dob|date of birth|birth ?date|ssn|home address|residential address|details|balance)\b"
SUBJECT_BARE = r"(?i:(?<!staff )(?<!team )\b(?:member|patient)\b)|\bM[- ]?\d{5,12}\b|\b(?:CLM|PA|INV)-\d+|(?i:\bNPI\b)\W{0,3}\d{5,12}|\b(?:Dr|Ms|Mr|Mrs)\.?\s+[A-Z]\w+"
CHANGE = r"(?i)\b(?:updat\w*|chang\w*|correct\w*|edit\w*|replac\w*|modif\w*|new|add|moved?|submit\w*)\b"
VALUE = r"[^\s@]{1,64}@[^\s@]{1,64}|(?<![A-Za-z0-9-])\d{6,}|\d{4}-\d{2}-\d{2}"
NPI_DIGITS = r"(?i)\bNPI\b\W{0,3}[\d -]{5,}"
SENTENCE_END = r"(?<!\bDr)(?<!\bMs)(?<!\bMr)(?<!\bMrs)[.?!;\n]+"
TARGET = r"\[(?:PERSON|MEMBER|PROVIDER)_\d+\]|\[MEMBER_ID\]|\[HEALTH_ID\]|\[NPI\]|\b(?:CLM|PA|INV)-\d+"
HEALTH_ASKED = (r"(?i)\b(?:name|full name|phone|phone no\.?|number|contact|mobile|dob|birth|birthday|address|e-?mail|who|whose|which patient|owner|owns|owned|"
                r"details|identity|identify|ssn|plan)\b")
STATUS_ID = r"(?i)\b(?:CLM|PA)-\d+"
PERSON_TOKEN = r"\[(?:PERSON|MEMBER|PROVIDER)_\d+\]|\[MEMBER_ID\]|\[HEALTH_ID\]|\[NPI\]"
PERSONAL = r"(?i)\b(?:phone|e-?mail|home address|address|dob|date of birth|birth ?date|ssn|plan|name)\b"
NO_RECORDS = ("ops_employee", "auditor", "knowledge_owner")  # roles that may not read other people's records


def _asked(verb: str) -> str:
    """A verb, then a subject and an attribute in either order, within a sentence."""
    gap = r"[^.?!]{0,70}?"
    return rf"(?i)\b{verb}\b{gap}\b{SUBJECT}{gap}\b{ATTRIBUTE}\b|\b{verb}\b{gap}\b{ATTRIBUTE}\b{gap}\b{SUBJECT}"


def any_of(patterns: tuple[str, ...] | str) -> str:
    """One pattern for all. Those that begin at a word's bound are tried together behind it: at any other character
    one look at the bound is enough, instead of one for each pattern."""
    if isinstance(patterns, str):
        return "(?i)" + patterns
    bound = [p[2:] for p in patterns if p.startswith(r"\b") and not _open_bar(p)]
    parts = [p for p in patterns if not p.startswith(r"\b") or _open_bar(p)]
    return "(?i)" + "|".join([r"\b(?:" + "|".join(f"(?:{p})" for p in bound) + ")"] * bool(bound) + [f"(?:{p})" for p in parts])


def _open_bar(pattern: str) -> bool:
    """Whether a pattern has alternatives outside of any group, which begin anew."""
    depth = inside = 0
    for k, c in enumerate(pattern):
        if k and pattern[k - 1] == "\\":
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            return True
    return False


def _hit(pattern: str, norm: Column, *views: Column) -> Column:
    """Whether a pattern is in the plain view or in one that differs from it and from the views before it."""
    out, tried = norm.rlike(U + pattern), [norm]
    for v in views:
        new = F.lit(True)
        for t in tried:
            new = new & (v != t)
        out, tried = out | (new & v.rlike(U + pattern)), [*tried, v]
    return F.coalesce(out, F.lit(False))


def guard_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with injection, clinical, sensitive and legal; columns of these names are replaced. Null texts have none.

    Attempts to steer are looked for in all four views, the others in the plain and the joined one."""
    made = ("injection", "clinical", "sensitive", "legal")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in made]).alias("row")
    x = df.select(row, iso_effective_dates(normalize_text(F.col(f"`{text}`"))).alias("norm"))
    x = x.select("row", "norm", collapse_letters(F.col("norm")).alias("joined"), fold_leet(F.col("norm")).alias("leet"))
    x = x.select(*x.columns, collapse_letters(F.col("leet")).alias("leet_joined"))
    norm, joined = F.col("norm"), F.col("joined")
    return x.select("row.*", _hit(any_of(INJECTION), norm, joined, F.col("leet"), F.col("leet_joined")).alias("injection"), _hit(any_of(CLINICAL), norm, joined).alias("clinical"),
                    _hit(any_of(SENSITIVE), norm, joined).alias("sensitive"), _hit(any_of(LEGAL), norm, joined).alias("legal"))


def account_requests(df: DataFrame, text: str = "text", role: str | None = None, **known) -> DataFrame:
    """The rows with account_specific and denied; columns of these names are replaced. Null texts ask for nothing.

    A text asks for a record where a verb, a subject and an attribute stand together, where a sentence without a
    word of change looks one up, or where one names a subject (or a known first name) and an attribute and gives no
    value; and only where the masked text still holds a person, an identifier or a record's number. A health
    identifier beside a personal word is enough. ``role`` is a column: roles without access to records are denied,
    but for the status of a record by its number."""
    made = ("account_specific", "denied")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    asker = F.col(f"`{role}`") if role else F.lit(None).cast("string")
    x = df.select(F.struct(*kept).alias("given"), asker.alias("role"), iso_effective_dates(normalize_text(F.col(f"`{text}`"))).alias("norm"))
    x = mask_pii(x, "norm", **known)
    x = x.select("given", "role", "norm", "masked", collapse_letters(F.col("norm")).alias("joined"))
    names = sorted(set(FIRST_NAMES) - set(NO_NAMES) - set(AMBIGUOUS))
    person = rf"(?<![\w\[\]-]){CAP}(?!\w)".replace(")*", ")*+")

    def bare(s: Column) -> Column:
        gives = F.regexp_replace(s, U + NPI_DIGITS, "NPI").rlike(U + VALUE)
        named = F.exists(F.regexp_extract_all(s, F.lit(U + person), 0), lambda w: F.lower(w).isin(names))
        return s.rlike(U + ATTRIBUTE_BARE) & ~s.rlike(U + CHANGE) & ~gives & (s.rlike(U + SUBJECT_BARE) | named)

    def looked_up(s: Column) -> Column:
        return s.rlike(U + _asked(ASKING_WEAK)) & ~s.rlike(U + CHANGE)

    def in_sentences(view: str) -> Column:
        return F.exists(F.split(view, SENTENCE_END, -1), lambda s: looked_up(s) | bare(s))

    asked = _hit(_asked(ASKING), F.col("norm"), F.col("joined")) | in_sentences("norm") | ((F.col("joined") != F.col("norm")) & in_sentences("joined"))
    health = F.col("masked").contains("[HEALTH_ID]") & F.col("masked").rlike(U + HEALTH_ASKED)
    specific = F.coalesce((asked & F.col("masked").rlike(TARGET)) | health, F.lit(False))
    status = F.col("masked").rlike(STATUS_ID) & ~F.col("masked").rlike(PERSON_TOKEN) & ~F.col("norm").rlike(U + PERSONAL)
    x = x.select("given", "role", specific.alias("account_specific"), status.alias("status"))
    return x.select("given.*", "account_specific", F.coalesce(F.col("account_specific") & F.col("role").isin(*NO_RECORDS) & ~F.col("status"), F.lit(False)).alias("denied"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") == "user", "ops_employee").otherwise("ops_manager").alias("asker"))


QUERIES = {
    "guard_flags": lambda s, d: guard_flags(table(s, d, "documents").select("doc_id", "text")).drop("text"),
    "account_requests": lambda s, d: account_requests(_turns(s, d), role="asker").select("conv_id", "turn", "account_specific", "denied"),
}
SQL: dict[str, str] = {}
