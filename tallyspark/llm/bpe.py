"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

Encoding.  A byte-pair tokenization is the only token sequence in which every two
neighbours are stable, that is no merge crosses their boundary before both are built; and
each of its beginnings is the tokenization of that much text.  So one pass over the bytes
suffices: for each end position the last token is the one that is stable after the last
token where it begins.  Tokens go out as soon as all positions that a later token may
begin at agree on them.

Sufficient lookahead.  If more text follows, only merges of a chain can differ: each one
overlaps the one before it by a byte or more, comes later in the merge list, and reaches
further left; the first one touches the new text.  (A merge can differ only where one
listed before it did, among the bytes it covers; merges of equal place differ from left to
right and so never reach further left.)  ``lookahead`` is the longest way left such a chain
can go, over all chains whose tokens agree on the bytes they share: 3,231 bytes for the
50,000 merges of the public byte-level vocabulary.  Tokens that end further than that from
the end of what was read are final, so a stream keeps that many bytes and one token at most,
whatever the length of the text; it raises if it ever had to keep more.

Decoding.  Ids become bytes and bytes become characters as soon as they are complete, by
an incremental UTF-8 decoder that replaces what is malformed.

Text is cut where the vocabulary's own pattern cuts; letters and numbers are those of the
library's Unicode version, asked of the library.  Short pieces are remembered in a bounded
table.  Strings of the vocabulary's added tokens become their ids, as in the library.
Truncation and padding of the file are not used.

Null and empty texts: no ids.  Very long texts, with or without white space: in windows,
so what is held besides the text itself does not grow.  Repeated rows: each its own row.
Extra columns are ignored.  Empty table: no row.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import tidy

RECORD = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters read at a time, and the longest piece that is remembered.
WINDOW, SHORT = 1 << 16, 48
#: Fixed value: the pattern of byte-level vocabularies; {L} and {N} are letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: The same for texts that hold letters, decimal digits and other signs of all versions only.
PLAIN = re.compile(PATTERN.replace("[^\\s{L}{N}]", r"(?:[^\s\w]|_)").replace("{L}", r"[^\W\d_]").replace("{N}", r"\d"))
NEVER = 1 << 62


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, all other bytes for 256 and up, in order."""
    shown = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    other = iter(range(256, 512))
    return {chr(b if b in shown else next(other)): b for b in range(256)}


def sufficient_lookahead(merged: list[bytes]) -> int:
    """Bytes that a difference can reach left of new text; tokens in the order of the merge
    list.  ``reach`` of a token is the furthest place left of the end at which a chain of
    merges may arrive with it: its own length where it touches the end, or a place within
    it plus the reach of an earlier token that agrees with it from there on."""
    whole: dict[bytes, int] = {}
    begun: dict[bytes, int] = {}
    for token in merged:
        reach = len(token) - 1
        for p in range(1, len(token)):
            rest = token[p:]
            found = max(begun.get(rest, 0), max((whole.get(rest[:q], 0) for q in range(1, len(rest))), default=0))
            if found:
                reach = max(reach, p + found)
        whole[token] = reach
        for q in range(1, len(token) + 1):
            begun[token[:q]] = max(begun.get(token[:q], 0), reach)
    return max(whole.values(), default=0)


class Transducer:
    """The merge list as tables; ``piece`` and ``stream`` encode by them."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.ids, self.rank = ids, {}
        self.left = {i: [(i, NEVER)] for t, i in ids.items() if len(t) == 1}
        self.right = {i: [(i, NEVER)] for i in self.left}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tokens, sure = {t: i for t, i in ids.items() if len(t) == 1}, set(self.left)
        listed = [(ids[a], ids[b], ids[a + b], a + b) for a, b in merges]
        for at, (a, b, both, _) in enumerate(listed):
            if both in self.left or not (a in self.left and b in self.left):
                raise ValueError("each merge must make a new token of tokens that are known")
            self.rank[a, b] = at
            consumed = lambda edge, at=at: [(i, min(until, at)) for i, until in edge]
            self.left[both], self.right[both] = [(both, NEVER), *consumed(self.left[a])], [(both, NEVER), *consumed(self.right[b])]
        # A token counts if its own bytes give it: no other merge crosses its middle first.
        for a, b, both, token in listed:
            if a in sure and b in sure and self._stable(a, b, self.rank[a, b]):
                self.tokens[token] = both
                sure.add(both)
        # Every end of a token, with the token's id or -1 where the end is none itself.
        self.ends = {t[i:]: -1 for t in self.tokens for i in range(len(t))}
        self.ends.update(self.tokens)
        lengths: dict[bytes, set[int]] = {}
        for t in self.tokens:
            lengths.setdefault(t[:3], {1, 2}).add(len(t))
        self.lengths = {begin: sorted(n, reverse=True) for begin, n in lengths.items()}
        self.longest = max(map(len, self.tokens), default=1)
        self.lookahead = sufficient_lookahead([x[3] for x in listed])

    def _stable(self, a: int, b: int, before: int = NEVER) -> bool:
        """No merge listed earlier than ``before`` crosses the boundary of a and b while
        both of its sides are there; at equal places the left merge comes first."""
        rank = self.rank
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                at = rank.get((x, y))
                if at is not None and at < before and at < until_x and at <= until_y:
                    return False
        return True

    def stable(self, a: int, b: int) -> bool:
        """The same over all merges, remembered in ``pairs``."""
        if len(self.pairs) >= 200_000:
            self.pairs.clear()
        found = self.pairs[a, b] = self._stable(a, b)
        return found

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece that is read whole.  Tokens that are stable after one
        another are tried, long ones first; a place from which none leads on is not tried
        again, since only one stable sequence leads to it.  What reaches the end is the ids."""
        tokens, lengths, pairs, size = self.tokens, self.lengths, self.pairs, len(data)
        out, ats, closed, before, at = [], [], set(), -1, 0
        while at < size:
            for n in lengths.get(data[at : at + 3], (2, 1)):
                if at + n <= size and at + n not in closed and (token := tokens.get(data[at : at + n])) is not None:
                    if before < 0 or ((ok := pairs.get((before, token))) or ok is None and self.stable(before, token)):
                        out.append(token)
                        ats.append(at)
                        before, at = token, at + n
                        break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                closed.add(at)
                out.pop()
                at, before = ats.pop(), out[-1] if out else -1
        return out


class Stream:
    """One piece, fed in parts of any size."""

    def __init__(self, of: Transducer):
        self.of, self.data, self.last, self.size = of, b"", [-1], [0]
        self.most = of.lookahead + of.longest

    def push(self, data: bytes) -> list[int]:
        """Read on; the ids that have become final, if there are many bytes."""
        out: list[int] = []
        step = max(self.most, 4096)
        for at in range(0, len(data), step):
            self._read(data[at : at + step])
            if len(self.data) > 2 * self.most:
                out += self._settle()
        return out

    def _read(self, data: bytes) -> None:
        of, last, size = self.of, self.last, self.size
        ends, pairs, stable, start = of.ends, of.pairs, of.stable, len(self.data)
        self.data = data = self.data + data
        for end in range(start + 1, len(data) + 1):
            fit, n = [], end - 1
            while n >= 0 and (token := ends.get(data[n:end])) is not None:
                if token >= 0:
                    fit.append((n, token))
                n -= 1
            for at, token in reversed(fit):
                if (before := last[at]) < 0 or ((ok := pairs.get((before, token))) or ok is None and stable(before, token)):
                    last.append(token)
                    size.append(end - at)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _ids(self, end: int) -> list[int]:
        out = []
        while self.size[end]:
            out.append(self.last[end])
            end -= self.size[end]
        return out[::-1]

    def _settle(self) -> list[int]:
        """Ids before the last place that the ways from all places where a token may still
        begin have in common; the rest is kept, with the token before it."""
        end, size = len(self.data), self.size
        shared, at = {end}, end
        while size[at]:
            at -= size[at]
            shared.add(at)
        common = end
        for at in range(max(0, end - self.of.longest + 1), end):
            while at not in shared:
                at -= size[at]
            common = min(common, at)
        if end - common > self.most:
            raise AssertionError("lookahead exceeded")
        out = self._ids(common)
        self.data, self.last, self.size = self.data[common:], self.last[common:], [0, *size[common + 1 :]]
        return out

    def finish(self) -> list[int]:
        return self._ids(len(self.data))


class Decoder:
    """Ids to text, a part at a time."""

    def __init__(self, table: dict[int, bytes]):
        self.table, self.text = table, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.text.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.text.decode(b"", True)


class Pieces(dict):
    """Piece -> its ids as bytes of little-endian 32-bit integers.  At ``limit`` pieces
    those that were not used since the time before are forgotten."""

    def __init__(self, transducer: Transducer, limit: int = 150_000):
        super().__init__()
        self.transducer, self.limit, self.before = transducer, limit, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            ids = self.transducer.piece(piece.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """One vocabulary file, with the pattern that cuts its texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = byte_characters()
        spelled = lambda token: bytes(map(byte.__getitem__, token))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ids = {spelled(t): i for t, i in file["model"]["vocab"].items()}
        self.transducer = Transducer([(spelled(a), spelled(b)) for a, b in pairs], ids)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.table = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.pieces, self.pattern = Pieces(self.transducer), regex.compile(pattern)
        self.odd = _odd()
        self.cut = regex.compile(r"(?r)(?<=\S)\s")  # no piece holds white space after something else
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text in parts, as bytes of little-endian 32-bit integers."""
        at = 0
        for m in self.apart.finditer(text):
            yield from self._plain(text, at, m.start())
            yield np.array([self.added[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, stop: int) -> Iterator[bytes]:
        known = self.pieces
        while at < stop:
            end = stop
            if stop - at > WINDOW:
                m = self.cut.search(text, at + 1, at + WINDOW)
                if not m:  # no white space: piece by piece
                    at = yield from self._spans(text, at, stop)
                    continue
                end = m.start()
            pattern = PLAIN if self.odd.isdisjoint(text[at:end]) else self.pattern
            yield b"".join(map(known.__getitem__, pattern.findall(text, at, end)))
            at = end

    def _spans(self, text: str, at: int, stop: int) -> Iterator[bytes]:
        """Pieces up to about a window, long ones fed to a stream in parts; where they end."""
        begun, out = at, []
        for m in self.pattern.finditer(text, at, stop):
            a, at = m.span()
            if at - a <= WINDOW:
                out.append(self.pieces[m[0]])
            else:
                yield b"".join(out)
                out, stream = [], Stream(self.transducer)
                for i in range(a, at, WINDOW):
                    yield np.array(stream.push(text[i : min(at, i + WINDOW)].encode()), "<u4").tobytes()
                out.append(np.array(stream.finish(), "<u4").tobytes())
            if at - begun >= WINDOW:
                break
        yield b"".join(out)
        return at


@functools.lru_cache
def pattern_of(path: str) -> str:
    """``PATTERN`` with the library's letters and numbers.  Characters that this Python's
    Unicode tables do not have are asked of the library's own cutting."""
    from tokenizers import Tokenizer

    kinds = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}")}
    new = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    asked = [(kind, c) for kind, own in kinds.items() for c in new if own.match(c)]
    probe = "".join(f"\n.{'a' if kind == 'L' else '1'}{c}" for kind, c in asked)
    starts = {a for _, (a, _) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(probe)}
    not_yet = {kind: [c for i, (k, c) in enumerate(asked) if k == kind and 4 * i + 3 in starts] for kind in kinds}
    pattern = PATTERN
    for kind, chars in not_yet.items():
        pattern = pattern.replace(f"{{{kind}}}", rf"[\p{{{kind}}}--[{_ranges(chars)}]]" if chars else rf"\p{{{kind}}}")
    return "(?V1)" + pattern


@functools.cache
def _odd() -> frozenset[str]:
    """Characters that ``PLAIN`` may see otherwise: numbers that are no decimal digits,
    separators that count as white space in Python alone, and those that this Python's
    tables do not have."""
    plain = re.compile(r"\w")
    kinds = ((c, unicodedata.category(c)) for c in map(chr, range(0x110000)))
    return frozenset(c for c, k in kinds if k in ("No", "Nl", "Cn") or "\x1c" <= c <= "\x1f" or bool(plain.match(c)) != (k[0] in "LN" or c == "_"))


def _ranges(chars) -> str:
    """A character class body of ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str | None = None) -> Codec:
    """One codec per process and vocabulary."""
    key = (path, pattern or pattern_of(path))
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            yield doc_id.as_py(), text.as_py() or ""
        tidy()


def encode(docs: DataFrame, tokenizer: str, most: int = 1 << 16) -> DataFrame:
    """(doc_id, part, ids): the ids of each document's text, in parts of ``most`` ids and up to
    a window more."""
    pattern = pattern_of(tokenizer)
    kind = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for doc_id, text in _texts(batches):
            part, held = 0, []
            for ids in own.encode(text):
                held.append(ids)
                if sum(map(len, held)) >= 4 * most:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([part]), pa.array([np.frombuffer(b"".join(held), "<i4")], pa.list_(pa.int32()))], schema=kind)
                    part, held = part + 1, []
            if held or not part:
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([part]), pa.array([np.frombuffer(b"".join(held), "<i4")], pa.list_(pa.int32()))], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, part long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are none."""
    pattern = pattern_of(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(tokenizer, pattern).table
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                own = Decoder(table)
                texts.append(own.push(ids.as_py() or []) + own.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of the text that they
    decode to.  Ids are decoded and digested part by part as they become final."""
    pattern = pattern_of(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column("text"):
                n, ids_digest, text_digest, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(own.table)
                for ids in own.encode(text.as_py() or ""):
                    n += len(ids) // 4
                    ids_digest.update(ids)
                    text_digest.update(back.push(np.frombuffer(ids, "<u4").tolist()).encode())
                text_digest.update(back.finish().encode())
                counts.append(n)
                coded.append(ids_digest.hexdigest())
                decoded.append(text_digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RECORD)
