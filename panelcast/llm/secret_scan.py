"""Secret scans: three plain patterns, and a token-efficiency test for random strings.

Ordinary text takes few tokens of a byte-pair vocabulary; random keys take many. A run of key characters
whose characters per token fall below the ratio for its length is a secret, unless it is a known kind of digest or
identifier: a digest in hex, a UUID, a number or date, a book or account number whose check digits hold, a whole e-mail
address, or the host of an address. Letters with
at most four digits behind them could be a name and need a lower ratio. Of a run that is no secret itself the pieces
between ``/``, ``_`` and ``-`` are tested, of an address each part. Spans are in code points, the end excluded.

Defined results: null text is empty; overlapping spans of different kinds are all reported; of a ``token`` span
that overlaps plain kinds the parts outside of those stay; repeated rows are scanned once each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from panelcast.llm.text import map_rows, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-pair vocabulary of this kind cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "token")
MASK = "[SECRET]"
MIN_LENGTH = 12
#: Least lengths with the ratio that holds from there, for keys and for what could be a name.
KEY_RATIOS = ((20, 2.0), (MIN_LENGTH, 1.75))
NAME_RATIOS = ((20, 1.9), (16, 1.6))
#: Keys with marks between their characters are tested whole from this length.
MARKED_LENGTH = 20

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key")
# of a maximal run, only a long one counts, so the least length can be part of the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.@:-]{%d,}" % MIN_LENGTH)
_KEY = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"  # digests
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"  # UUIDs
    r"|[0-9+/_=.:-]+", re.IGNORECASE)  # numbers, dates, rules of dashes
_MAIL = re.compile(r"(?:mailto:)?[A-Za-z0-9_.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}[.:]?")
_HOST = re.compile(r"(?:://(?:[^/@]*@)?|@)((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63})(?=[:/.]|$)")
#: Letters with at most four digits behind them, joined by single marks: names of code, files, hosts and paths.
_NAME = re.compile(r"/?(?:[A-Za-z]*[0-9]{0,4})(?:[/_.:-][A-Za-z]*[0-9]{0,4})*")
_MARKS = "/_-"
_BOOK = re.compile(r"ISBN(?:-1[03])?[:=-]?((?:[0-9]-?){9}[0-9X]|97[89]-?(?:[0-9]-?){9}[0-9])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def is_checked(key: str) -> bool:
    """Whether the key is a book number (ISBN) or account number (IBAN) of the right check digits."""
    if book := _BOOK.fullmatch(key):
        digits = [10 if c == "X" else int(c) for c in book[1].replace("-", "")]
        if len(digits) == 10:
            return sum(d * w for d, w in zip(digits, range(10, 0, -1))) % 11 == 0
        return sum(d * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10 == 0
    return bool(_ACCOUNT.fullmatch(key)) and int("".join(str(int(c, 36)) for c in key[4:] + key[:4])) % 97 == 1


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if _KEYWORD.search(text.lower()):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return spans


def is_random(key: str, count_tokens: Callable[[str], int]) -> bool:
    """Whether the key takes many tokens for its length and is no known kind of identifier."""
    marked = any(mark in key for mark in _MARKS)
    if len(key) < (MARKED_LENGTH if marked else MIN_LENGTH) or len(set(key)) < 8 or _KNOWN.fullmatch(key):
        return False
    named = _NAME.fullmatch(key)
    if named and marked:
        return False
    ratio = next((ratio for least, ratio in (NAME_RATIOS if named else KEY_RATIOS) if len(key) >= least), 0.0)
    return len(key) < ratio * count_tokens(key)


def random_parts(text: str, start: int, end: int, count_tokens: Callable[[str], int], marks: str = _MARKS,
                 whole: bool = True) -> list[tuple[int, int]]:
    """The key from ``start`` to ``end`` if it is random, else what is random of its pieces between the marks."""
    key = text[start:end]
    if len(key) < MIN_LENGTH or _KNOWN.fullmatch(key) or is_checked(key):
        return []
    known = any(len(piece) >= 32 and _KNOWN.fullmatch(piece) for piece in key.replace("_", "/").split("/"))
    if whole and not known and is_random(key, count_tokens):
        return [(start, end)]
    if not marks:
        return []
    if marks[0] not in key:
        return random_parts(text, start, end, count_tokens, marks[1:], not whole)
    out = []
    for piece in key.split(marks[0]):
        out += random_parts(text, start, start + len(piece), count_tokens, marks[1:])
        start += len(piece) + 1
    return out


def token_spans(text: str, count_tokens: Callable[[str], int]) -> list[tuple[str, int, int]]:
    spans = []
    for run in _RUN.finditer(text):
        if _KNOWN.fullmatch(run[0]) or _MAIL.fullmatch(run[0]):
            continue
        whole, at = "://" not in run[0], run.start()
        hosts = [(run.start() + m.start(1), run.start() + m.end(1)) for m in _HOST.finditer(run[0])] if not whole or "@" in run[0] else []
        for a, b in [*hosts, (run.end(), run.end())]:
            for m in _KEY.finditer(text, at, a):
                spans += [("token", *part) for part in random_parts(text, *m.span(), count_tokens, whole=whole)]
            at = b
    return spans


def outside(span: tuple[str, int, int], plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The parts of a span that no plain span covers; one of the latter that covers none of it changes nothing."""
    kind, start, end = span
    out = []
    for _, a, b in sorted(plain, key=lambda s: s[1:]):
        if a < end and b > start:
            out.append((kind, start, a))
            start = b
    return [s for s in [*out, (kind, start, end)] if s[1] < s[2]]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(text: str | None, count_tokens: Callable[[str], int]) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    if not text:
        return []
    plain = plain_spans(text)
    added = [part for s in token_spans(text, count_tokens) for part in outside(s, plain)]
    return ordered(plain + [s for s in added if any(c.isalnum() for c in text[s[1]:s[2]])])


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced."""
    if not spans:
        return text
    parts, done = [], 0
    for _, start, end in spans:
        if start >= done:
            parts += [text[done:start], MASK]
        done = max(done, end)
    return "".join([*parts, text[done:]])


#: The last encoding that the worker built, by the number of its broadcast.
_encodings: dict[str, tiktoken.Encoding] = {}


def token_counter(number: str, shared) -> Callable[[str], int]:
    """Counts tokens; the worker builds the encoding once from the broadcast ranks."""
    if number not in _encodings:
        _encodings.clear()
        _encodings[number] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
    encoding = _encodings[number]
    return lambda key: len(encoding.encode_ordinary(key))


def scanner(spark: SparkSession, vocabulary: str = VOCABULARY):
    """Spans of each text of a batch. The driver reads the vocabulary (about 1 MB) and broadcasts it."""
    shared, number = spark.sparkContext.broadcast(load_ranks(vocabulary)), uuid.uuid4().hex

    def scan(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        count = token_counter(number, shared)
        return [secret_spans(t, count) for t in texts]

    return scan


def query(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    scan = scanner(docs.sparkSession, vocabulary)

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        found = scan(batch.column("text").to_pylist())
        base = [[s for s in spans if s[0] != "token"] for spans in found]
        counts = [[sum(s[0] == kind for s in spans) for spans in base] for kind in KINDS[:3]]
        digests = [hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]
        return [*counts, digests, [listed(spans) for spans in found]]

    added = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_rows(docs.select("doc_id", "text"), of_batch, added).drop("text")


def mask_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All documents and columns, with secrets masked in ``text`` and ``n_chars``, if there, counted anew where it changed."""
    scan = scanner(docs.sparkSession, vocabulary)
    has_length = "n_chars" in docs.columns

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            new = [masked(t, spans) for t, spans in zip(texts, scan(texts))]
            changed = {"text": pa.array(new, batch.schema.field("text").type)}
            if has_length:
                lengths = [n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), texts, new)]
                changed["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(
                [changed.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
