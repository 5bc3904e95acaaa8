"""Spans of personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds out
how reliable each is, and a classifier trained on its posteriors decides about the spans that no rule settles.

Base spans come from exact patterns (email, ip, card, phone) and always stay. Further candidates, found by looser
patterns, are possible personal data: obfuscated addresses, card and phone numbers in other shapes, numbers of
documents and accounts after their name, secrets after a key word or of a known make. Labelers vote 1 (personal), 0
(not) or abstain:

- regex: how well the span keeps to the shape of its kind;
- gazetteer: known providers, makes and key words in the span or right before it, and placeholders;
- context: the words around it (contact, card, password, id ... or version, page, total ...);
- checksum: Luhn's of card numbers behind an issuer's prefix, the remainder by 97 of account numbers, parts of dates;
- spread: how many bits a character carries in the span, and whether the same ones come again and again.

Votes are counted by pattern over the whole corpus (at most 243 patterns a kind, whatever the corpus), which is all
that EM needs: a two-class model with two accuracies for each kind and labeler, one a class, since a labeler's word on a
number says nothing about its word on a secret. Its posteriors are the soft labels of the final
classifier, a logistic regression on hashed features of the span and its surroundings and not on the votes: character
runs, shape, groups of digits, lengths, neighbours. So it can overrule the votes where spans that look alike got
others. It is fitted on a bounded sample, the ``sample`` different spans (with their neighbours) that are least in
order of their hash. Spans go to the end of their token however long it is, and their features are of all of it;
the parts of an address keep the lengths that addresses may have (64 and 63 characters). A candidate is added if its probability is at least ``least``; overlapping additions go to the
earlier, then longer one, and none may overlap a base span. Names of people are not looked for.

Null and empty texts have no spans, an empty table gives an empty model, which adds nothing. Offsets count code points. Equal texts have equal spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.runtime import Stash, prepare

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "checksum", "spread")
#: A labeler's accuracy on each class is taken to be so high at least.
LEAST = 0.6
MORE = ("email_obfuscated", "number", "secret", "document")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Key words and makes of secrets, names of documents, gazetteer and context words: fixed lists of this operator.
_SECRET = "password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|bearer"
_DOCUMENT = "passport|ssn|social security|iban|account|acct|licen[cs]e|tax id|national id|id card"
_MAKE = r"\b(?:AKIA[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|sk_(?:live|test)_[A-Za-z0-9]{8,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
_LOOSE = {
    "email_obfuscated": re.compile(r"(?<![A-Za-z0-9._%+-])(?P<v>[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[A-Za-z]{2,})"),
    "number": re.compile(r"(?P<v>\(?[0-9][0-9 ().-]{6,}[0-9])"),
    "secret": re.compile(rf"(?ia:(?:{_SECRET}))s?[\"']?[ \t]{{0,2}}(?:[:=]|=>|is\b)?[ \t]{{0,2}}[\"']?(?P<v>[^\s\"',;<>:=]{{6,}})|(?P<make>{_MAKE})"),
    "document": re.compile(rf"(?ia:\b(?:{_DOCUMENT}))[ :#.]{{0,3}}(?ia:no|nr|number|num)?[ :#.]{{0,3}}(?P<v>[A-Za-z]{{0,3}}[0-9][A-Za-z0-9-]{{3,}})"),
}
#: What every match holds, so that texts without it are not searched; of the lower-cased text where words are meant.
_NEED = {
    "email_obfuscated": re.compile(r"(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(]? ?(?:dot|DOT)"), "number": re.compile(r"[0-9][0-9 ().-]{6}"),
    "secret": re.compile("passw|passphrase|pwd|secret|token|key|credential|bearer|akia|gh[pousr]_|sk_|xox|eyj"), "document": re.compile("passport|ssn|social|iban|acc|licen|tax|national|id card"),
}
_LOWERED = ("secret", "document")
_KNOWN = re.compile(r"(?i)\b(?:gmail|yahoo|outlook|hotmail|mail|example|com|org|net|edu|visa|mastercard|amex|iban|ssn|passport|tel|fax|akia|password|token|secret)\b|^(?:akia|gh[pousr]_|sk_|xox|eyj)")
_GIVEN = re.compile(r"[:=][ \t]{0,2}[\"']?$")
_PROSE = re.compile(rf"(?ia)\b(?:the|a|an|his|her|its|our|their|of|no|any|some|this|that)[ \t]+(?:{_SECRET})s?[ \t]*$")
_EMPTY = re.compile(r"(?i)^(?:your|my|the|changeme|example|placeholder|none|null|true|false|required|field|x+|\*+)")
_NAME = re.compile(rf"(?ia:\b(?:{_DOCUMENT})[ :#.]{{0,3}}(?:no|nr|number|num)?[ :#.]{{0,3}}$)")
_FOR = re.compile(r"(?i)\b(?:contact|email|e-mail|mail|call|phone|tel|mobile|card|account|ssn|passport|password|token|secret|key|id|reach|login|auth)\b")
_AGAINST = re.compile(r"(?i)\b(?:version|page|section|chapter|total|sum|year|isbn|issn|no|figure|table|license|copyright|result)\b")
NEAR = 24  # characters of context on each side


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), sorted. Each pattern's matches are leftmost and don't overlap; then checks apply."""
    out, at = [], 0
    i = text.find("@")
    while i >= 0:  # a match ends its local part here: it starts at the first of the characters before that may be in one
        s = i
        while s > at and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, i) if s < i else None
        if m:
            out.append((s, 0, m.end()))
            at = m.end()
        i = text.find("@", max(i + 1, at))
    # a match begins where its digits do: from a later one it would fail alike, so the pattern looks at no other
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


#: Prefixes of card numbers by issuer, the shape of account numbers (IBAN), and of dates.
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-](?:0?[1-9]|1[0-2])[ .-](?:0?[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0?[1-9]|[12][0-9]|3[01])[ .-](?:0?[1-9]|1[0-2])[ .-](?:19|20)[0-9]{2}(?![0-9])")


def remainder97(account: str) -> int:
    """Of an account number, its first four characters moved to the end and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _checked(k: int, span: str) -> int:
    """What checksums say: 1, 0 or -1."""
    d = _digits(span)
    if k == 1:
        if 13 <= len(d) <= 19 and _ISSUER.match(d):
            return int(luhn(d))
        return 0 if _DATE.match(span) else -1
    if k == 3 and _IBAN.match(plain := span.replace("-", "").upper()):
        return int(remainder97(plain) == 1)
    return -1


def bits(span: str) -> float:
    """Entropy of the span's own characters, in bits a character."""
    n = np.array(list(Counter(span).values())) / max(1, len(span))
    return float(-(n * np.log2(n)).sum())


def _spread(k: int, span: str) -> int:
    if k == 2:
        return 1 if len(span) >= 12 and bits(span) >= 3 else 0 if bits(span) < 2 else -1
    if k in (1, 3):
        return 0 if len(set(_digits(span))) <= 2 else -1
    return -1


def _votes(k: int, span: str, before: str, after: str) -> tuple[int, ...]:
    """What the labelers say of a candidate, in the order of LABELERS: 1, 0 or -1 to abstain."""
    return (*_named(k, span, before, after), _checked(k, span), _spread(k, span))


def _named(k: int, span: str, before: str, after: str) -> tuple[int, int, int]:
    """The votes by shape, gazetteer and context."""
    n, letters = len(_digits(span)), sum(c.isalpha() for c in span)
    if k == 1:
        shape = 1 if n in (9, 10, 11, 15, 16) else 0 if n < 9 else -1
    elif k == 2:
        shape = 0 if span.isalpha() and (span.islower() or span.istitle()) else 1 if n and letters or len(span) >= 16 else -1
    elif k == 3:
        shape = 1 if n >= 8 else 0 if n < 5 else -1
    else:
        shape = 1
    if k == 2:  # the key word is there in any case
        given = _GIVEN.search(before)
        known = 0 if _EMPTY.search(span) else 1 if _KNOWN.search(span) or given else -1 if n else 0
        return shape, known, 1 if given and not _PROSE.search(before) else 0 if _PROSE.search(before) else -1
    known = 1 if _KNOWN.search(before[-12:] + span) else 0 if k == 1 else -1
    around = before + " | " + after
    if k == 3:  # the name of the document is there in any case; what stands around both tells
        around = _NAME.sub(" ", before) + " | " + after
        return shape, known, 0 if _AGAINST.search(around) else 1 if _FOR.search(around) else -1
    return shape, known, 1 if _FOR.search(around) else 0 if _AGAINST.search(around) else -1


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(start, index in MORE, end, votes) of loose matches clear of base spans."""
    out, starts, low = [], [s for s, _, _ in base], text.lower()
    ends = list(accumulate((e for _, _, e in base), max))
    for k, kind in enumerate(MORE):
        if not _NEED[kind].search(low if kind in _LOWERED else text):
            continue
        for m in _LOOSE[kind].finditer(text):
            a, b = m.span("v") if m["v"] is not None else m.span("make")
            if text[b - 1] in ".)!?" and kind == "secret":
                b -= 1
            i = bisect_left(starts, b)
            if i and ends[i - 1] > a:
                continue
            out.append((a, k, b, _votes(k, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR])))
    return out


#: Hashed features of the classifier.
DIM = 1 << 12
_CLASS = {**dict.fromkeys("0123456789", "9"), **dict.fromkeys(" \t\n", " ")}


def _class(c: str) -> str:
    return _CLASS.get(c) or ("A" if c.isupper() else "a" if c.isalpha() else c)


def features(k: int, span: str, before: str, after: str) -> list[int]:
    """The buckets of a candidate's features: of the span as it looks, and of what stands next to it."""
    kinds = [_class(c) for c in span]
    shape = "".join(c for i, c in enumerate(kinds) if i == 0 or kinds[i - 1] != c)
    plain = re.sub("[0-9]", "9", span.lower())
    words = re.findall(r"[^\W\d_]+", before.lower())[-1:], re.findall(r"[^\W\d_]+", after.lower())[:1]
    n = max(1, len(span))
    said = ["", f"length {len(span).bit_length()}", f"exact {min(len(span), 50)}", f"shape {shape}", f"ends {kinds[0]}{kinds[-1]}", "groups " + "-".join(str(len(g)) for g in re.findall("[0-9]+", span))]
    said += [f"{c} share {4 * kinds.count(c) // n}" for c in "9Aa"] + [f"different {len(set(span)) * 4 // n}", f"luhn {luhn(d)}" if 12 <= len(d := _digits(span)) <= 19 else "no luhn"]
    said += [f"before {words[0]}", f"after {words[1]}", f"touches {_class(before[-1:] or ' ')}{_class(after[:1] or ' ')}", f"sign {re.sub('[^:=#]', '', before[-4:])}"]
    said += [f"run {plain[i : i + 3]}" for i in range(len(plain) - 2)]
    return sorted({zlib.crc32(f"{k} {x}".encode("utf-8", "surrogatepass")) % DIM for x in said})


def _spans(docs: DataFrame) -> DataFrame:
    """Every candidate of the corpus: kind k, votes (a figure a labeler, 2 to abstain), a hash of the span and its
    surroundings, and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                for s, k, e, votes in candidates(t, base_spans(t)) if t else ():
                    before, after = t[max(0, s - NEAR) : s], t[e : e + NEAR]
                    name = hashlib.blake2b(f"{k}\0{before}\0{t[s:e]}\0{after}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    rows.append((k, "".join(str(v % 3) for v in votes), name, np.array(features(k, t[s:e], before, after), np.uint16).tobytes()))
            types = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=["k", "votes", "name", "at"])

    return docs.mapInArrow(run, "k int, votes string, name binary, at binary")


def _said(votes: str) -> tuple[int, ...]:
    return tuple(-1 if v == "2" else int(v) for v in votes)


def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(prior, accuracy) by EM from counts of (kind, vote, vote ...): the share of personal spans of each kind, and for
    each kind and labeler how often it is right on each class (not personal, personal) when it doesn't abstain. Pseudo-counts
    put it at 0.8 to begin with, and labelers are taken to be better than chance: ``LEAST`` at least, or a labeler that only ever
    says no would be held for wrong as soon as the others are silent."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind, votes = np.array([k[0] for k in keys], int), np.array([k[1:] for k in keys], int)
    prior, right = np.full(len(MORE), 0.5), np.full((len(MORE), votes.shape[1], 2), 0.8)
    for _ in range(rounds):
        p = posteriors(kind, votes, prior, right)
        for k in range(len(MORE)):
            mine = kind == k
            w, q = n[mine], p[mine]
            prior[k] = ((w * q).sum() + 2) / (w.sum() + 4)
            for j in range(votes.shape[1]):
                v = votes[mine, j]
                right[k, j, 1] = ((w * q)[v == 1].sum() + 8) / ((w * q)[v >= 0].sum() + 10)
                right[k, j, 0] = ((w * (1 - q))[v == 0].sum() + 8) / ((w * (1 - q))[v >= 0].sum() + 10)
            right[k] = np.maximum(right[k], LEAST)
    return prior, right


def posteriors(kind: np.ndarray, votes: np.ndarray, prior: np.ndarray, right: np.ndarray) -> np.ndarray:
    yes, no = np.log(prior[kind]), np.log(1 - prior[kind])
    for j in range(votes.shape[1]):
        v, one, none = votes[:, j], right[kind, j, 1], right[kind, j, 0]
        yes = yes + np.where(v == 1, np.log(one), np.where(v == 0, np.log(1 - one), 0))
        no = no + np.where(v == 0, np.log(none), np.where(v == 1, np.log(1 - none), 0))
    return 1 / (1 + np.exp(no - yes))


def train(docs: DataFrame, text: str = "text", sample: int = 20_000, steps: int = 200, stash: Stash | None = None) -> dict[str, np.ndarray]:
    """The classifier's weights; none if the corpus has no candidate."""
    prepare(docs.sparkSession)
    stash = stash or Stash(docs.sparkSession, "pii")
    spans = stash.keep(_spans(docs.select(text)), "spans")
    counts = {(r["k"], *_said(r["votes"])): r["n"] for r in spans.groupBy("k", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 243 a kind
    if not counts:
        return {}
    prior, right = reliabilities(counts)
    got = spans.groupBy("name").agg(F.min(F.struct("k", "votes", "at")).alias("s")).orderBy("name").limit(sample).select("s.*").collect()
    soft = posteriors(np.array([r["k"] for r in got]), np.array([_said(r["votes"]) for r in got]), prior, right)
    return {"weights": fitted([np.frombuffer(r["at"], np.uint16) for r in got], soft, steps)}


def fitted(rows: list[np.ndarray], soft: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of the logistic regression of soft labels on rows of feature buckets, by adaptive gradient steps."""
    at, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, seen = np.zeros(DIM), np.full(DIM, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, w[at], len(rows))))
        g = np.bincount(at, (p - soft)[row], DIM) / len(rows) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def probability(weights: np.ndarray, at: list[int]) -> float:
    return float(1 / (1 + np.exp(-weights[at].sum())))


def all_spans(text: str, model: dict[str, np.ndarray], least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """(base, all): base as base_spans gives them; all as (start, kind, end) with the additions, sorted."""
    base = base_spans(text)
    added, end = [], -1
    for a, k, b, _ in sorted(candidates(text, base), key=lambda c: (c[0], -c[2], c[1])) if model else ():
        if a >= end and probability(model["weights"], features(k, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR])) >= least:
            added.append((a, MORE[k], b))
            end = b
    order = {k: i for i, k in enumerate(KINDS + MORE)}
    return base, sorted([(s, KINDS[k], e) for s, k, e in base] + added, key=lambda x: (x[0], order[x[1]]))


def find(docs: DataFrame, model: dict[str, np.ndarray], least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base and spans: kind:start:end joined by commas, by start and kind."""
    prepare(docs.sparkSession)
    docs = docs.select(key, text)
    names = [key, *(f"n_{k}" for k in KINDS), "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, every = all_spans(t, model, least) if t else ([], [])
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(4)), ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base), ",".join(f"{k}:{s}:{e}" for s, k, e in every)))
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"n_{k} long" for k in KINDS), "base string", "spans string"])
    return docs.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])
