"""Names and listed literals in texts: one automaton for all lists, one walk over capital words, both a task long.

Lists (names with their kind, mailboxes, phones, addresses) are compiled once a task into an Aho-Corasick
automaton, so a text is read once however long they are. What is found is kept as spans; a text is put together
again once, when it is known which names are the same person. Patterns only ever repeat single characters or
words, and Python's matcher keeps no stack for them, so long chains of names are only long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First names, words that are no part of a name, names that are words too, verbs after and cues
# before a first name that stands alone, shapes of names. Masks must not differ.
FIRST_NAMES = """aarav aditya akash amit ananya anil anjali arjun arun asha ashok deepak divya gaurav geeta gopal harish harsh ishaan jaya
kavita kiran krishna lakshmi madhu mahesh manish meena meera mohan mukesh nandini naveen neeta neha nikhil nisha pooja prakash pranav
priyanka rahul rajesh rakesh ramesh ravi rekha rohan rohit sachin sanjana sanjay santosh shweta siddharth sneha sunil sunita suresh
sushma swati tanvi tarun uma usha varun vijay vikram vinod vivek yash
jan pieter hans juan jose carlos luis pedro miguel sofia elena marco giuseppe""".split()
NO_NAMES = """provider providers enrollment operations operation triage service desk utilization management claims claim
compliance privacy clinical review senior team teams manager portal policy policies request requests address billing record records
document documents department division group office clinic hospital health care plan member patient network pharmacy
authorization prior access reset password login status update change changes name names number numbers email phone
road street lane avenue nagar colony marg cross boulevard layout block sector path chowk circle
chennai mumbai delhi bengaluru pune hyderabad kolkata jaipur austin denver texas california
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october
november december
please thanks thank regards hello dear sir madam urgent kindly also then this that these those there here with from
period notice form forms standard general basic basics draft approval approved expired active stale""".split()
AMBIGUOUS = """will mark grace rose chase hope joy faith dawn bill page art rich sue pat ray rod dean lane hunter summer winter
drew gene ward wade max sandy carol jay guy earl miles sky rain ivy lily amber crystal daisy heather holly iris jasmine olive pearl
ruby violet basil brooks cliff dale mason miller porter ross victoria france jordan paris florence austin sydney cody dallas""".split()
VERBS = """wants needs called calls asked asks said says is was has had will would can could moved moves changed emailed
requested requests submitted sent confirmed reported left works worked lives lived signed approved rejected wrote
phoned messaged replied mentioned noted came visited wishes got did may might should must""".split()
CUES = "to for from by with contact call ask assign assigned forward forwarded cc attn attention regarding named called email emailed".split()
PARTICLES = r"(?:de la|del|della|de|van der|van den|van de|van|von|der|den|bin|bint|al|el|le|la|di|da|dos|das|du)"
CAP = r"(?:[A-Z]['’][A-Z][a-z]+|Mc[A-Z][a-z]+|[A-Z][a-z]+)(?:[-'’][A-Z][a-z]+)*"
SURNAME = rf"(?:{PARTICLES}\s+){{0,4}}{CAP}"  # a bound, so that a chain of particles is not read again from each of them
NAME = rf"{CAP}(?:\s+{SURNAME}){{0,2}}"
TITLES = "Dr Mr Ms Mrs Miss Prof".split()

_TITLED = re.compile(rf"\b({'|'.join(TITLES)})\b\.?\s+({NAME})")
_BEFORE_NAME = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(TITLES)})\.?\s+$")
_RENAMED = re.compile(rf"(?i:\bname\b)([^.\n]{{0,25}}?)(?i:\bfrom\b)\s+({NAME})\s+(?i:to)\s+({NAME})")
_NAMED_TO = re.compile(rf"(?i:\bname\b)([^.\n\[]{{0,25}}?)(?i:\bto\b)\s+({NAME})")
_CAPITAL = re.compile(rf"(?<![\w\[\]-]){SURNAME}(?!\w)")
_FOLLOWED = re.compile(rf"['’]s\b|\s+(?:{'|'.join(VERBS)})\b")
_CUED = re.compile(rf"(?i)\b(?:{'|'.join(CUES)})\s+$")
_NEAR = re.compile(r"[ \t]{1,2}")
_HYPHENS = re.compile("['’-]")
TITLE_REACH, CUE_REACH = 12, 30  # characters before a name in which its title or cue stands


def _key(name: str) -> str:
    return " ".join(name.lower().split())


def _lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Literals:
    """Listed words in texts, longest first from the left; ``whole`` ones only between what is no word character."""

    def __init__(self, words: Iterable[tuple[str, str, bool]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind, whole in words:
            if word:
                self.automaton.add_word(_lowered(word), (len(word), kind, whole, word))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __bool__(self) -> bool:
        return len(self.automaton) > 0

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, word) of finds apart from each other."""
        if not len(self.automaton):
            return []
        hits = []
        for last, (n, kind, whole, word) in self.automaton.iter(_lowered(text)):
            start, end = last + 1 - n, last + 1
            if whole and ((start and _is_word(text[start - 1])) or (end < len(text) and _is_word(text[end]))):
                continue
            hits.append((start, -n, end, kind, word))
        out, at = [], 0
        for start, _, end, kind, word in sorted(hits):
            if start >= at:
                out.append((start, end, kind, word))
                at = end
        return out


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class People:
    """The persons of one text: tokens by name, in the order of the passes that found them."""

    def __init__(self) -> None:
        self.tokens: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.by_first: dict[str, str] = {}

    def token(self, name: str, kind: str) -> str:
        key = _key(name)
        if key not in self.tokens:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.tokens[key] = f"[{kind}_{self.counts[kind]}]"
            self.by_first.setdefault(key.split()[0], self.tokens[key])
        return self.tokens[key]

    def alone(self, first: str) -> str:
        """A first name that stands alone is the person first seen with it."""
        return self.by_first.get(first.lower()) or self.token(first, "PERSON")


class NameWalk:
    """Finds and replaces the names of texts; lists are compiled once."""

    def __init__(self, listed: dict[str, str], first_names: Iterable[str], stop_terms: Iterable[str], cueless: bool = True):
        self.kinds = {_key(n): k.upper() for n, k in listed.items()}
        self.listed = Literals((" ".join(n.split()), k, True) for n, k in listed.items())
        self.first, self.cueless = {n.lower() for n in first_names if len(n) >= 3 and n.isalpha()}, cueless
        self.stop, self.ambiguous = set(NO_NAMES) | {t.lower() for t in stop_terms}, set(AMBIGUOUS)

    def __call__(self, text: str) -> tuple[str, bool]:
        people, edits, rest = People(), [], text

        def keep(found: list[tuple[int, int, str]]) -> None:
            # what is found can't be part of a later find: it is blanked, so that places stay
            nonlocal rest
            edits.extend(found)
            for start, end, _ in found:
                rest = rest[:start] + "[" + "\ue002" * (end - start - 2) + "]" + rest[end:]

        found = []
        for start, end, _, word in self.listed.spans(text):
            title = _BEFORE_NAME.search(text, max(0, start - TITLE_REACH), start)
            found.append((title.start() if title else start, end, people.token(word, self.kinds[_key(word)])))
        keep(found)
        keep([(m.start(), m.end(), people.token(m[2], "PROVIDER" if m[1] == "Dr" else "PERSON")) for m in _TITLED.finditer(rest)])
        if "name" in _lowered(rest):
            keep([(m.start(), m.end(), f"name{m[1]}from {people.token(m[2], 'PERSON')} to {people.token(m[3], 'PERSON')}") for m in _RENAMED.finditer(rest)])
            keep([(m.start(), m.end(), f"name{m[1]}to {people.token(m[2], 'PERSON')}") for m in _NAMED_TO.finditer(rest)])
        if self.cueless and self.first:
            keep(list(self.walk(rest, people)))
        if not edits:
            return text, False
        out, at = [], 0
        for start, end, put in sorted(edits):
            out += [text[at:start], put]
            at = end
        return "".join([*out, text[at:]]), True

    def is_first(self, word: str) -> bool:
        """A known first name, or a compound one of whose parts is known, that is no business word."""
        parts = _HYPHENS.split(word)
        return word not in self.stop and (word in self.first or (len(parts) > 1 and any(p in self.first for p in parts)))

    def walk(self, text: str, people: People) -> Iterator[tuple[int, int, str]]:
        """First names that another capital word follows, or that stand alone with a verb after or a cue before them."""
        words = _CAPITAL.finditer(text)
        m = next(words, None)
        while m:
            follower, word = next(words, None), m[0].lower()
            if self.is_first(word):
                if follower and _NEAR.fullmatch(text, m.end(), follower.start()) and follower[0].lower() not in self.stop:
                    yield m.start(), follower.end(), people.token(f"{m[0]} {follower[0]}", "PERSON")
                    follower = next(words, None)
                elif word not in self.ambiguous and (_FOLLOWED.match(text, m.end()) or _CUED.search(text[max(0, m.start() - CUE_REACH) : m.start()])):
                    yield m.start(), m.end(), people.alone(m[0])
            m = follower


def masked_names(text: Column, listed: dict[str, str], first_names: Iterable[str], stop_terms: Iterable[str], cueless: bool = True) -> Column:
    """struct(text, changed): names as tokens. Null stays null."""
    given = (dict(listed), list(first_names), list(stop_terms), cueless)

    @F.pandas_udf("text string, changed boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        walk = NameWalk(*given)
        for s in batches:
            done = [walk(t) if isinstance(t, str) else (None, False) for t in s]
            yield pd.DataFrame({"text": pd.Series([d[0] for d in done], dtype=object), "changed": [d[1] for d in done]})

    # so marked, projections before and after are not folded into one with it
    return run.asNondeterministic()(text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("name", T.StringType())])))
def titled_names(texts: pd.Series) -> pd.Series:
    """Names behind a title, in order."""
    return pd.Series([[{"title": m[1], "name": " ".join(m[2].split())} for m in _TITLED.finditer(t)] if isinstance(t, str) else [] for t in texts], dtype=object)


def masked_literals(text: Column, emails: Iterable[str], phones: Iterable[str], addresses: Iterable[str]) -> Column:
    """struct(text, types): listed mailboxes, phones (whole) and addresses as [EMAIL], [PHONE] and [ADDRESS]."""
    given = [(w, k, k == "PHONE") for k, words in (("EMAIL", emails), ("PHONE", phones), ("ADDRESS", addresses)) for w in words]

    @F.pandas_udf("text string, types array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lists = Literals(given)

        def one(text):
            if not isinstance(text, str):
                return None, []
            out, types, at = [], set(), 0
            for start, end, kind, _ in lists.spans(text):
                out += [text[at:start], f"[{kind}]"]
                types.add(kind)
                at = end
            return "".join([*out, text[at:]]), sorted(types)

        for s in batches:
            done = [one(t) for t in s]
            yield pd.DataFrame({"text": pd.Series([d[0] for d in done], dtype=object), "types": pd.Series([d[1] for d in done], dtype=object)})

    return run.asNondeterministic()(text)
