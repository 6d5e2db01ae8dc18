"""Words, their hashes and library tokenization, shared by the text operators.

All helpers work on one Arrow batch at a time and keep bounded caches per Python
worker, so memory does not follow the input.
"""

from __future__ import annotations

import contextlib
import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class HashCache(dict):
    """word -> 64-bit hash; forgets everything at ``limit`` entries."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashes(words: list, cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int, multiplier: np.uint64 = M1) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (order counts)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = mix(h[:m] + np.uint64(n))
        for i in range(1, n):
            out = (out ^ h[i : i + m]) * multiplier
            out ^= out >> np.uint64(29)
    return mix(out)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unblob(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(b, dtype)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, with the length appended."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate(([0], cut, [len(sorted_keys)]))


# White space of the vocabulary files' patterns (Unicode White_Space).
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LEADING = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", f"[{_WS}]?[^{_WS}]+|[{_WS}]+(?![^{_WS}])"))
# Texts in which not every space but each line break starts a unit (RE2 syntax).
_RARE = rf"[{_WS.replace(' ', '').replace('t-', 't' + chr(92) + 'x{0b}-')}\x{{00}}]|  | \n|\n |\n\n\n|\A |[ \n]\z"
_TAIL = ".,;:!?*#&$%|()[]{}<>/\\\"'+-=_@^~`"


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of every run, end to end."""
    reach = np.cumsum(size)
    return np.repeat(first - reach + size, size) + np.arange(reach[-1] if len(reach) else 0)


def _after(texts: pa.StringArray, size: np.ndarray) -> pa.StringArray:
    """What follows the first size[i] bytes of each text (none null)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    left = np.diff(offsets) - size
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[_runs(offsets[:-1] + size, left)]
    ends = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data))


class Encoder:
    """Whole-text encoding by the tokenizers library, one encode per distinct unit.

    A unit is a stretch at whose ends the tokenizer's own pre-tokenizer always
    cuts, so concatenated unit ids equal the ids of the whole text.  ``spaced``
    (byte-level vocabularies): a white-space character and the run after it, or
    other white space.  Otherwise (white space dropped): a run without white space.
    Punctuation that ends a unit after a letter or digit is cut off where the unit is
    new.  Units that are still unseen are encoded joined by a separator that is always
    one token of its own.  Known units and their ids are flat arrays; at ``limit``
    units the half that was used last stays.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.limit = spaced, limit
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.mark = "\n" if spaced else "0"  # holds no unit that is encoded joined
        self.joint = "\n" if spaced else " 0 "
        (self.mark_id,) = self.tokenizer.encode(self.joint, add_special_tokens=False).ids
        self.known, self.ids = pa.array([], pa.string()), np.empty(0, self.dtype)
        self.size, self.used, self.turn = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def units(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Keys of the texts' units end to end, and how many each text has.  With
        ``spaced`` a plain key stands for a space and the word after it, "\0" marks a
        unit that is spelled out."""
        if not self.spaced:
            listed = pc.ascii_split_whitespace(texts)
            return listed.flatten(), np.diff(listed.offsets.to_numpy())
        listed = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0"), texts, ""), "\n", " \n"), " ")
        rare = pc.match_substring_regex(texts, _RARE)
        if pc.any(rare).as_py():
            spelled = pa.array([["\0" + u for u in _LEADING.findall(t)] for t in texts.filter(rare).to_pylist()], pa.list_(pa.string()))
            place = np.arange(len(texts))
            place[rare.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(spelled))
            listed = pa.concat_arrays([listed, spelled]).take(pa.array(place))
        return listed.flatten(), np.diff(listed.offsets.to_numpy())

    def _tokenize(self, keys: pa.StringArray) -> np.ndarray:
        """Add units and the ids that the library gives them; their places."""
        alone, spelled = pc.match_substring(keys, self.mark), keys
        if self.spaced:
            out = pc.starts_with(keys, "\0")
            alone = pc.or_(alone, out)
            plain = pc.if_else(pc.starts_with(keys, "\n"), keys, pc.binary_join_element_wise(pa.scalar(" "), keys, ""))
            spelled = pc.if_else(out, pc.utf8_slice_codeunits(keys, 1), plain)
        joined, single = spelled.filter(pc.invert(alone)), spelled.filter(alone)
        encode, ids, sizes = self.tokenizer.encode_batch_fast, [self.ids], [self.size]
        bounds = np.append(np.arange(0, len(joined), 1024), len(joined))
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), joined), self.joint).to_pylist()
        for n, e in zip(np.diff(bounds).tolist(), encode(chunks, add_special_tokens=False)):
            found = np.array(e.ids, self.dtype)
            cut = np.flatnonzero(found == self.mark_id)
            assert len(cut) == n - 1
            ids.append(found[found != self.mark_id])
            sizes.append(np.diff(cut, prepend=-1, append=len(found)) - 1)
        for e in encode(single.to_pylist(), add_special_tokens=False):
            ids.append(np.array(e.ids, self.dtype))
            sizes.append([len(e)])
        order, place = np.argsort(alone.to_numpy(zero_copy_only=False), kind="stable"), np.empty(len(keys), np.int64)
        place[order] = len(self.known) + np.arange(len(keys))
        self._add(keys.take(pa.array(order)), np.concatenate(ids), np.concatenate(sizes).astype(np.int64))
        return place

    def _add(self, keys: pa.StringArray, ids: np.ndarray, size: np.ndarray) -> None:
        self.known, self.ids, self.size = pa.concat_arrays([self.known, keys]), ids, size
        self.used = np.concatenate((self.used, np.full(len(size) - len(self.used), self.turn)))

    def _coded(self, units: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
        """Number of each unit: its place in ``known``, or after it in the unseen ones."""
        coded = pa.concat_arrays([self.known, units]).dictionary_encode()
        return coded.indices.slice(len(self.known)).to_numpy(), coded.dictionary.slice(len(self.known))

    def _numbers(self, units: pa.StringArray) -> np.ndarray:
        """Places of all units in ``known``, unseen ones learnt."""
        n, (number, new) = len(self.known), self._coded(units)
        if not len(new):
            return number
        core = pc.utf8_rtrim(new, characters=_TAIL)
        last = pc.utf8_slice_codeunits(core, -1)
        cut = pc.and_(pc.and_(pc.less(pc.binary_length(core), pc.binary_length(new)), pc.utf8_is_alnum(last)), pc.not_equal(last, "\u0130"))  # lower case of \u0130 ends in a mark
        whole, stem = new.filter(pc.invert(cut)), core.filter(cut)
        tail = _after(new.filter(cut), pc.binary_length(stem).to_numpy())
        if self.spaced:
            tail = pc.binary_join_element_wise(pa.scalar("\0"), tail, "")
        place, fresh = self._coded(pa.concat_arrays([whole, stem, tail]))
        place = np.concatenate((np.arange(n), self._tokenize(fresh)))[place]
        first = np.cumsum(self.size) - self.size
        parts = place[len(whole) :].reshape(2, -1).T.ravel()  # stem, tail, stem, tail ...
        added = self.size[parts].reshape(-1, 2).sum(axis=1)
        at, both = len(self.known), np.concatenate((self.ids, self.ids[_runs(first[parts], self.size[parts])]))
        self._add(new.filter(cut), both, np.concatenate((self.size, added)))
        where = np.arange(n + len(new))
        split = cut.to_numpy(zero_copy_only=False)
        where[n:][~split], where[n:][split] = place[: len(whole)], at + np.arange(len(stem))
        return where[number]

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        first = np.cumsum(self.size) - self.size
        self.ids = self.ids[_runs(first[keep], self.size[keep])]
        self.known, self.size, self.used = self.known.take(pa.array(keep)), self.size[keep], self.used[keep]

    def encode(self, texts: pa.StringArray, end: int) -> list[np.ndarray]:
        """The ids of each text (none null) with ``end`` appended, as arrays of ``dtype``."""
        if len(self.known) > self.limit:
            self._forget()
        self.turn += 1
        units, count = self.units(texts)
        number = self._numbers(units)
        self.used[number] = self.turn
        # Each text's units and the end, spread out to their ids.
        number = np.insert(number, np.cumsum(count), len(self.known))
        size = np.append(self.size, 1)
        first, ids = np.cumsum(size) - size, np.append(self.ids, np.array(end, self.dtype))
        taken = size[number]
        flat = ids[_runs(first[number], taken)]
        ends = np.cumsum(taken)[np.cumsum(count + 1) - 1]
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per Python worker."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def slices(sizes, most: int = 4_000_000):
    """Ranges of a batch with sizes of at most ``most`` together, one row at least."""
    at = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def tidy() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def whole_texts(batch: pa.RecordBatch, most: int = 4_000_000):
    """The texts of a batch (null: empty) with their range, in bounded parts."""
    texts = batch.column("text").fill_null("")
    for a, b in slices(pc.binary_length(texts).to_pylist(), most):
        yield a, b, texts.slice(a, b - a)
        tidy()
