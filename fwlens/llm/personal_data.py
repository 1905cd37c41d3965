"""Personal data in texts by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how
reliable each is, and a final classifier, trained on the resulting probabilities, decides.

* A scan of every whole text finds candidates of four kinds: the base spans (fixed patterns and checks), and looser forms:
  written-out or bracketed addresses, defanged and version 6 addresses, card numbers with other separators or beside
  other numbers, telephone numbers without a plus sign or run into other digits.
* Six labelers vote yes, no or nothing on each: pattern, validity (check digit, ranges), gazetteer (top-level domains,
  issuers, calling codes, special networks), shape, cue words in front, and what touches the span.
* A candidate's votes and four surface classes are one small number, its code. Codes are counted in Spark; there are at most
  3^6 * 4 * 4 * 4 * 3 = 139,968 per kind, so the driver fits on the counts of all candidates, whatever the input's size.
* Expectation-maximisation finds a rate of right votes per labeler and kind; a vote withheld is no evidence. A logistic
  regression on votes and surface classes then learns the probabilities, and accepts what it gives ``threshold``.

Base spans always stay; others are added where they touch none. Patterns start at single characters or at run starts, so
that no text takes quadratic time.

Cases: a null or empty text has no spans; repeated rows get equal rows; an empty table gives an empty result; other
columns are not read; of overlapping candidates the likelier, then the longer, then the earlier is kept.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fwlens.llm.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("pattern", "validity", "gazetteer", "shape", "cue", "border")
#: Sizes of the digits of a code: votes (0 none, 1 yes, 2 no), character before, character after, length, separators.
RADIX = (3,) * len(LABELERS) + (4, 4, 4, 3)
THRESHOLD, ROUNDS, CUE_CHARS = 0.8, 40, 40
#: Fixed values.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io dev app ai co me tv eu us uk ca au nz de at ch fr be lu nl es pt it mx ar cl"
    " br pe ie dk se no fi pl cz sk hu ro bg gr tr ru ua jp cn kr in id sg hk tw za ng ke eg il ae sa example test".split()
)
#: Fixed values.
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93"
    " 94 95 98 212 213 216 218 233 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886"
    " 961 962 964 965 966 968 971 972 974".split()
)
#: Words in front of such data, in English, French, German and Spanish.
CUES = (
    r"\b(?:e-?mail|mail|contact|write to|courriel|correo|adresse)\b",
    r"\b(?:ip|host|server|serveur|servidor|client|address|network)\b",
    r"\b(?:card|visa|mastercard|amex|credit|carte|karte|kreditkarte|tarjeta|cr[eé]dito|payment)\b",
    r"\b(?:tel|telephone|phone|call|fax|mobile|cell|t[eé]l[eé]phone|t[eé]l|telefon|handy|tel[eé]fono|m[oó]vil)\b",
)
_CUES = tuple(re.compile(cue, re.IGNORECASE) for cue in CUES)

_DIGIT = re.compile("[0-9]")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DIGITS_LINKED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_HIDDEN_AT = re.compile(
    rf"(?:{_OPEN}(?:at|@){_CLOSE}|\s@\s|\sat\s|＠)([A-Za-z0-9-]{{1,63}}(?:(?:{_OPEN}(?:dot|\.){_CLOSE}|\sdot\s|\.)[A-Za-z0-9-]{{1,63}})+)",
    re.IGNORECASE,
)
_HINTS = ("(at", "[at", "{at", "<at", "(AT", "[AT", "(@", "[@", " @ ", "＠", " dot ", " DOT ", "(dot", "[dot")
_DOT = re.compile(rf"{_OPEN}(?:dot|\.){_CLOSE}|\sdot\s", re.IGNORECASE)
_FENCED_QUAD = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_OPEN}(?:dot|\.){_CLOSE}|\s\.\s|\.)[0-9]{{1,3}}){{3}}(?![0-9.])", re.IGNORECASE)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:.])")
_CHAIN = re.compile("[0-9]+(?:[ \\-./_\u00a0\u2009\u202f]{1,2}[0-9]+)+")
_GROUPED = re.compile(r"(?<![0-9A-Za-z+.,/:-])(?:00[1-9][0-9]{0,2}|\([0-9]{2,5}\)|[0-9]{2,4})(?:[ .\-/]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z])")
_PLUS_GROUPS = re.compile(r"\+[1-9][0-9]{0,2}(?:[ ().-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for place, letter in enumerate(reversed(digits)):
        value = int(letter) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _plain(found: str) -> str:
    return "".join(_DIGIT.findall(found))


def _octets(found: str) -> bool:
    parts = [part.lstrip("0") for part in found.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _run_start(text: str, end: int, least: int) -> int:
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap within a kind."""
    spans, last = [], 0
    if "@" in text:
        for match in _AFTER_AT.finditer(text):
            start = _run_start(text, match.start(), last)
            if start < match.start():
                last = match.end()
                spans.append((EMAIL, start, last))
    if _DIGIT.search(text):
        spans += [(IP, *m.span()) for m in _QUAD.finditer(text) if _octets(m[0])]
        for match in _DIGITS_LINKED.finditer(text):
            if match.end() - match.start() >= 13 and 13 <= len(digits := _plain(match[0])) <= 19 and luhn(digits):
                spans.append((CARD, *match.span()))
        if "+" in text:
            spans += [(PHONE, *m.span()) for m in _PLUS.finditer(text) if 9 <= len(_plain(m[0])) <= 15]
    return spans


def _loose(text: str):
    """Further candidates."""
    if any(hint in text for hint in _HINTS):
        for match in _HIDDEN_AT.finditer(text):
            written = match[0][: match.start(1) - match.start()].strip().lower() == "at"
            # the bare word counts only where the dots are written out too
            if written and not _DOT.search(match[1]):
                continue
            start = _run_start(text, match.start(), 0)
            if start < match.start():
                yield EMAIL, start, match.end()
    if not _DIGIT.search(text):
        return
    if "[" in text or "(" in text or " . " in text:
        yield from ((IP, *m.span()) for m in _FENCED_QUAD.finditer(text))
    if ":" in text:
        for match in _COLONS.finditer(text):
            if "::" in match[0] or match[0].count(":") == 7:
                yield IP, *match.span()
    for match in _CHAIN.finditer(text):
        if match.end() - match.start() < 13:
            continue
        groups = [g.span() for g in re.finditer("[0-9]+", match[0])]
        for i, (first, _) in enumerate(groups):
            size = 0
            for low, high in groups[i:]:
                size += high - low
                if size > 19:
                    break
                if size >= 13 and luhn(_plain(match[0][first:high])):
                    yield CARD, match.start() + first, match.start() + high
    yield from ((PHONE, *m.span()) for m in _GROUPED.finditer(text))
    if "+" in text:
        yield from ((PHONE, *m.span()) for m in _PLUS_GROUPS.finditer(text))


def _email_votes(found: str):
    plain = _DOT.sub(".", found)
    domain = re.split(r"@|＠|\bat\b", plain, flags=re.IGNORECASE)[-1].strip(" ])}>")
    labels = domain.split(".")
    valid = all(label and label[0] != "-" and label[-1] != "-" for label in labels) and labels[-1].isalpha() and len(labels[-1]) > 1
    known = labels[-1].lower() in TOP_LEVEL
    return 0 if valid else 2, 1 if known else 2, 1 if any(c.isalpha() for c in found.split("@")[0]) else 0


def _ip_votes(found: str):
    if ":" in found:
        try:
            address = ipaddress.IPv6Address(found)
        except ValueError:
            return 2, 0, 0
        return 1, 2 if address.is_unspecified or address.is_loopback else 0, 1 if found.count(":") > 2 else 2
    parts = re.findall("[0-9]+", found)
    small = _octets(".".join(parts))
    first = int(parts[0][-4:])
    plain = all(part == "0" or part[0] != "0" for part in parts)
    return 0 if small else 2, 2 if first in (0, 127, 255) or max(map(len, parts)) == 1 else 0, 1 if plain else 2


def _card_votes(found: str):
    digits = _plain(found)
    issuer = digits[0] == "4" or 51 <= int(digits[:2]) <= 55 or 2221 <= int(digits[:4]) <= 2720 or digits[:2] in ("34", "37", "35", "65", "36", "38") or digits[:4] == "6011"
    shape = [len(group) for group in re.findall("[0-9]+", found)]
    usual = len(shape) == 1 or shape in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
    return 1 if luhn(digits) and 13 <= len(digits) <= 19 else 2, 1 if issuer else 2, 1 if usual else 2


def _phone_votes(found: str):
    digits = _plain(found)
    code = digits if found.startswith("+") else digits[2:] if found.startswith("00") else ""
    known = any(code[:size] in CALLING_CODES for size in (1, 2, 3)) if code else None
    groups = re.findall("[0-9]+", found)
    if "(" in found or len(groups) > 1 and len(groups[-1]) == 4 and len(groups[-2]) == 3:
        shape = 1
    else:
        shape = 2 if not code and len({len(group) for group in groups}) == 1 or len(groups) == 3 and len(groups[0]) == 4 else 0
    return 0 if 9 <= len(digits) <= (15 if code else 11) else 2, 0 if known is None else 1 if known else 2, shape


_VOTES = (_email_votes, _ip_votes, _card_votes, _phone_votes)


def _beside(char: str) -> int:
    return 0 if not char or char.isspace() else 1 if char in ".,;:!?()[]\"'" else 2 if char.isalnum() or char == "_" else 3


def code_of(text: str, kind: int, start: int, end: int, is_base: bool) -> int:
    """Votes and surface classes of a candidate as one number."""
    found = text[start:end]
    left, right = _beside(text[start - 1 : start]), _beside(text[end : end + 1])
    cue = 1 if _CUES[kind].search(text, max(0, start - CUE_CHARS), start) else 0
    # what goes on in letters or digits is part of something longer
    border = 2 if left == 2 or right == 2 else 0
    size, marks = end - start, sum(not c.isalnum() for c in found)
    digits = (1 if is_base else 0, *_VOTES[kind](found), cue, border, left, right, min(3, size // 8), min(2, marks // 2))
    code = 0
    for digit, radix in zip(reversed(digits), reversed(RADIX)):
        code = code * radix + digit
    return code


def candidates(text: str) -> list[int]:
    """kind, start, end, code of each candidate in one list; base spans vote yes by pattern."""
    base = base_spans(text)
    more = set(_loose(text)) - set(base)
    found = list(base)
    if more:
        taken = sorted((start, end) for _, start, end in base)
        starts = np.array([start for start, _ in taken], dtype=np.int64)
        reach = np.maximum.accumulate([end for _, end in taken]) if taken else starts
        for span in sorted(more):
            at = int(np.searchsorted(starts, span[2])) - 1
            if at < 0 or reach[at] <= span[1]:
                found.append(span)
    rows = []
    for place, span in enumerate(found):
        rows += [*span, code_of(text, *span, place < len(base))]
    return rows


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Digits of codes, a row each."""
    digits = np.empty((len(codes), len(RADIX)), dtype=np.int64)
    rest = np.asarray(codes, dtype=np.int64)
    for i, radix in enumerate(RADIX):
        rest, digits[:, i] = np.divmod(rest, radix)
    return digits


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each vote pattern, rate of right votes per labeler, and share of true candidates.

    Votes are 0 none, 1 yes, 2 no. Eight right and two wrong votes, and one candidate of each class, are taken as seen before;
    rates stay within 0.05 and 0.95 and the share within 0.02 and 0.9, so that labelers which all but agree do not settle
    what none of them saw.
    """
    sign = np.where(votes == 1, 1.0, np.where(votes == 2, -1.0, 0.0))
    cast = np.abs(sign)
    right, share = np.full(votes.shape[1], 0.8), 0.5
    truth = np.full(len(votes), 0.5)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + sign @ np.log(right / (1 - right))
        truth = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        agree = np.where(sign > 0, truth[:, None], 1 - truth[:, None]) * cast
        right = np.clip((counts @ agree + 8) / (counts @ cast + 10), 0.05, 0.95)
        share = float(np.clip((counts @ truth + 1) / (counts.sum() + 2), 0.02, 0.9))
    return truth, right, share


def _one_hot(digits: np.ndarray) -> np.ndarray:
    parts = [digits[:, [i]] == np.arange(radix) for i, radix in enumerate(RADIX)]
    return np.concatenate([np.ones((len(digits), 1)), *parts], axis=1).astype(float)


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression on probabilities, by Newton's steps."""
    weights = np.zeros(features.shape[1])
    for _ in range(25):
        guess = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (counts * (target - guess)) - ridge * weights
        curve = (features * (counts * guess * (1 - guess))[:, None]).T @ features + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return weights


_SCANNED = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.int32()))])


def _scanned(batches):
    for batch in batches:
        ids, texts = batch.columns
        found = [candidates(text) if (text := value.as_py()) else [] for value in texts]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], schema=_SCANNED)


def _counted(batches):
    for batch in batches:
        spans = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        if len(spans):
            pairs, counts = np.unique(spans[:, [0, 3]], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32)), pa.array(counts)], names=["kind", "code", "n"])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and found (kind, start, end, code in turn) of every row, stored."""
    return stored(documents.select("doc_id", "text").mapInArrow(_scanned, "doc_id bigint, found array<int>"))


def fit(scanned: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: the labelers' rates of right votes and the classifier's weights."""
    counted = scanned.select("found").mapInArrow(_counted, "kind int, code int, n bigint")
    table = counted.groupBy("kind", "code").agg(F.sum("n").alias("n")).orderBy("kind", "code").toPandas()
    model = {}
    for kind, rows in table.groupby("kind"):
        digits, counts = unpacked(rows["code"].to_numpy()), rows["n"].to_numpy(dtype=float)
        truth, right, _ = reliabilities(digits[:, : len(LABELERS)], counts)
        model[int(kind)] = (right, logistic(_one_hot(digits), truth, counts))
    return model


def _accepted(spans: np.ndarray, model, memo: dict, threshold: float) -> list[tuple[int, int, int]]:
    """Base spans and the likeliest of the others that overlap nothing taken before."""
    kept, others = [], []
    for kind, start, end, code in spans.tolist():
        if code % 3 == 1:
            kept.append((kind, start, end))
            continue
        key = (kind, code)
        if key not in memo:
            score = float((_one_hot(unpacked(np.array([code]))) @ model[kind][1])[0])
            memo[key] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if memo[key] >= threshold:
            others.append((-memo[key], start - end, start, end, kind))
    taken: list[tuple[int, int]] = []
    for _, _, start, end, kind in sorted(others):
        # what is taken is disjoint, so the last one that begins before this end tells
        place = bisect_left(taken, (end, 0))
        if not place or taken[place - 1][1] <= start:
            taken.insert(place, (start, end))
            kept.append((kind, start, end))
    return sorted(kept)


_OUT = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{kind}", pa.int64()) for kind in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)


def _said(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def _decided(model, threshold: float):
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        memo: dict = {}
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not found:
                    rows.append((doc_id, 0, 0, 0, 0, nothing, "", 0))
                    continue
                spans = np.array(found, dtype=np.int64).reshape(-1, 4)
                base = sorted((k, s, e) for k, s, e, code in spans.tolist() if code % 3 == 1)
                kept = _accepted(spans, model, memo, threshold)
                counts = [sum(span[0] == kind for span in base) for kind in range(4)]
                rows.append((doc_id, *counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(kept), len(kept) - len(base)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


def find_spans(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), n_added (others than base)."""
    scanned = scan(documents)
    fields = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _OUT)
    return scanned.mapInArrow(_decided(fit(scanned), threshold), fields)
