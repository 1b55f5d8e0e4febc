"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

``scan_secrets`` reads whole texts and returns, for each row, the pattern matches and the further tokens whose
log-likelihood ratio under two character Markov models says "random". A token that pattern matches cover in part is
judged whole, so the ends of a key don't stay behind a run of digits inside it; one that they cover is not judged.

The models learn from labelled samples: strings made by rule, and in all documents the values of pattern matches (random)
and the tokens of letters that no match touches (ordinary). Tokens with digits that no match touches have no label.

Null and empty texts have no spans, an empty table gives no rows, and very long texts are read in one sweep over tokens
and matches. Rows are independent, so repeated rows give repeated results, and no column but the two named ones is read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.textkit import give_back, small_batches

KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A token of the Markov stage. Shorter ones can't reach the least total ratio.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")
#: An ordinary token of the corpus: letters, or such parts joined.
_ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?:[_/-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])")
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Common parts of identifiers, joined by rule into samples of ordinary names.
_NAME_PARTS = "get set user name list item count index value data file path read write open close start stop time date key map type size table row column page text word line token query parse build render config option default error result response request handler manager service client server test main init load save update delete create find search filter sort order group merge split join".split()


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in _KEYWORDS) or not low.isascii():
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


_SIZE = len(_SYMBOLS) + 1
#: Symbol numbers by byte; all other bytes share the last, which also stands before a token.
_CODE = np.full(256, _SIZE - 1, np.int64)
_CODE[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(_SIZE - 1)


def transitions(strings: Iterable[str]) -> np.ndarray:
    """How often each symbol follows each other one in the strings, the start of a string being the last symbol."""
    codes = _CODE[np.frombuffer("\0".join(["", *strings]).encode("ascii", "replace"), np.uint8)]
    pairs = np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE).reshape(_SIZE, _SIZE)
    pairs[:, -1] = 0
    return pairs


class MarkovPair:
    """Order-one character models of random and of ordinary strings.

    ``threshold`` is the least log-likelihood ratio a character on average, ``least`` the least in total (nats).
    """

    def __init__(self, ratio: np.ndarray, threshold: float, least: float):
        self.ratio, self.threshold, self.least = ratio, threshold, least

    @classmethod
    def fit(cls, ordinary: list[np.ndarray], rand: list[np.ndarray], threshold: float = 0.45, least: float = 10.0) -> MarkovPair:
        """From transition counts of each label. No source weighs more than the first; every cell is smoothed by one half."""

        def logs(sources: list[np.ndarray]) -> np.ndarray:
            most = sources[0].sum()
            counts = 0.5 + sum(x * min(1.0, most / max(1, x.sum())) for x in sources)
            counts[:, -1] = 0.5
            return np.log(counts / counts.sum(axis=1, keepdims=True))

        return cls(logs(rand) - logs(ordinary), threshold, least)

    def scores(self, tokens: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each token, none of them empty."""
        raw = np.frombuffer("\0".join(["", *tokens]).encode("ascii", "replace"), np.uint8)
        codes, starts = _CODE[raw], np.flatnonzero(raw == 0)
        steps = self.ratio[codes[:-1], codes[1:]]
        steps[starts[1:] - 1] = 0.0
        return np.add.reduceat(steps, starts) if tokens else np.zeros(0)

    def are_random(self, tokens: list[str]) -> np.ndarray:
        totals = self.scores(tokens)
        return (totals >= self.least) & (totals >= self.threshold * np.array([len(t) for t in tokens]))


def labelled_strings(n: int = 6000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Ordinary and random strings by a seeded rule: names joined from common parts, numbers and dates; keys over the usual alphabets."""
    rng = random.Random(seed)
    ordinary, rand = [], []
    alphabets = ("0123456789abcdef", _SYMBOLS[:62], _SYMBOLS[26:62], _SYMBOLS[:26] + "0123456789", _SYMBOLS[:64], _SYMBOLS[:62] + "_-")
    for i in range(n):
        rand.append("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(12, 64))))
        parts = [rng.choice(_NAME_PARTS) for _ in range(rng.randint(2, 6))]
        style = i % 5
        if style == 0:
            name = parts[0] + "".join(p.title() for p in parts[1:])
        else:
            name = ("_", "-", "/", "")[style - 1].join(parts)
        if i % 7 == 0:
            name += str(rng.randint(0, 99))
        ordinary.append(name.upper() if i % 11 == 0 else name)
        if i % 4 == 0:
            ordinary.append("".join(rng.choices("0123456789", k=rng.randint(4, 20))))
            ordinary.append(("{:04}-{:02}-{:02}", "{:04}/{:02}/{:02}", "{:04}{:02}{:02}")[i % 3].format(rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)))
            ordinary.append(rng.choice("-=_/+") * rng.randint(2, 20))
    return ordinary, rand


def _values(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
    """What the matches hold: of an assignment its value. Only those with a digit are random for sure."""
    for start, kind, end in spans:
        value = _ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]
        if len(value) >= 12 and not value.isalpha():
            yield value


def corpus_transitions(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Transitions of ordinary tokens and of random values, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total = np.zeros((2, _SIZE, _SIZE), np.int64)
        for batch in small_batches(batches):
            plain, rand = [], []
            for value in batch.column(0).to_pylist():
                spans = base_matches(value) if value else []
                rand += _values(value, spans)
                last = 0
                for start, _, end in [*spans, (len(value or ""), 0, 0)]:
                    plain += _ORDINARY.findall(value or "", last, max(last, start))
                    last = max(last, end)
            total += np.stack([transitions(plain), transitions(rand)])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total.reshape(-1)[some], pa.int64())], ["cell", "n"])

    sums = docs.select(F.col(text)).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(2 * _SIZE * _SIZE, np.int64)
    total[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    ordinary, rand = total.reshape(2, _SIZE, _SIZE)
    return ordinary, rand


def in_capitals(counts: np.ndarray) -> np.ndarray:
    """A tenth of the transitions between small letters, as those of capitals: names are also written that way."""
    out = np.zeros_like(counts)
    out[26:52, 26:52] = counts[:26, :26] // 10
    out[-1, 26:52] = counts[-1, :26] // 10
    return out


def fit_markov(docs: DataFrame, text: str = "text") -> MarkovPair:
    """Fits the models on the strings made by rule and on the labelled tokens of all documents."""
    plain, rand = labelled_strings()
    own_plain, own_rand = corpus_transitions(docs, text)
    return MarkovPair.fit([transitions(plain), own_plain + in_capitals(own_plain)], [transitions(rand), own_rand])


def text_spans(text: str, model: MarkovPair | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern matches, and all spans: those and the random tokens, except tokens that the matches cover. No model, no tokens."""
    base = base_matches(text)
    if model is None:
        return base, base
    tokens, at, covered = [], 0, -1
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        # Both are in order: ``covered`` is how far the matches that begin at or before the token's start reach, gaplessly.
        while at < len(base) and base[at][0] <= max(start, covered):
            covered = max(covered, base[at][2])
            at += 1
        if covered < end:
            tokens.append((start, 3, end))
    found = model.are_random([text[s:e] for s, _, e in tokens]).tolist()
    return base, sorted(base + [t for t, hit in zip(tokens, found, strict=True) if hit])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("is_base", pa.bool_())]))


def scan_secrets(docs: DataFrame, model: MarkovPair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and ``spans``, an array of (kind, start, end, is_base) in code points, by start and then kind."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for value in batch.column(1).to_pylist():
                _, spans = text_spans(value or "", frozen.value)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "is_base": k < 3} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,is_base:boolean>>")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the joined spans of ``scan_secrets``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda x: x["is_base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count(KINDS[3]),
    )


def redact(docs: DataFrame, model: MarkovPair, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``mark``; null stays null."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if value is None:
            return None
        _, spans = text_spans(value, frozen.value)
        out, last = [], 0
        for start, _, end in spans:
            if start >= last:
                out += [value[last:start], mark]
            last = max(last, end)
        return "".join([*out, value[last:]]) if out else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in small_batches(batches):
            columns = list(batch.columns)
            columns[at] = pa.array(map(clean, columns[at].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
