"""Token ids with the tokenizers library, each distinct run of letters, digits or signs encoded once.

Both vocabularies used here cut a text between a letter and a digit or sign, before a white space that follows anything
else, before the last of several white spaces, and after one that is not a space; no token crosses such a cut. So a
text's ids are those of its runs. numpy finds the cuts in the bytes of a batch; a Python worker keeps
the runs it has met in an Arrow array with their ids, so that each goes through the library once, many new ones in one call: as
the tokens of a call spell its bytes, the bytes tell where a run's tokens end. Beside a character that is not ASCII a
cut needs the library's word that it is a letter once normalised. Apostrophes and control characters cut nothing. The
table is begun anew when it is full. A text with another sort of white space, or with a sign of special tokens, is
encoded as a whole. The tests compare with encoding whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUNS = 1_000_000
#: New runs in one call.
CALL = 256
_RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\v\f\r")
_LETTER, _DIGIT, _SIGN, _WHITE, _SPACE, _GLUE = range(1, 7)
_KIND = np.full(256, _LETTER, np.uint8)  # letters, and all bytes of characters that are not ASCII
_KIND[:128] = _GLUE
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SIGN
_KIND[ord("'")] = _GLUE
_KIND[[9, 10, 11, 12, 13]] = _WHITE
_KIND[32] = _SPACE
#: By the kinds before and after a place: 1 if it is a cut, 2 if it is one where the white space ends after one more.
_CUT = np.zeros(64, np.uint8)
for _a in range(1, 7):
    for _b in range(1, 7):
        _blank = (_a in (_WHITE, _SPACE), _b in (_WHITE, _SPACE))
        _CUT[_a * 8 + _b] = {(False, True): 1, (True, True): 2, (True, False): int(_a == _WHITE), (False, False): int(_a != _b and _GLUE not in (_a, _b))}[_blank]
_WHITE_END = np.array([chr(_c).isspace() for _c in range(128)] + [False] * 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters of one or two bytes that are in lower case and never compose with each other.
_LETTERS = "a-zß-öø-ÿ"


def _mapped(buf: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``by[buf]`` of bytes, which may not be written to."""
    return np.frombuffer(buf.tobytes().translate(by.tobytes().ljust(256, b"\0")), np.uint8)


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class _Table:
    """Ids of distinct runs, one after another."""

    def __init__(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros(1, np.int32)

    def add(self, runs: pa.Array, rows: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """Runs with their ids and the number of each."""
        ids, used = np.concatenate(rows), int(self.starts[-1])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, (used + np.cumsum(np.concatenate(sizes))).astype(np.int32)])
        self.known = pa.concat_arrays([self.known, runs])

    def gather(self, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered runs one after another, and the number of each."""
        lists = pa.ListArray.from_arrays(pa.array(self.starts), pa.array(self.flat))
        taken = lists.take(pa.array(no))
        return taken.values.to_numpy(), np.diff(taken.offsets.to_numpy())


class Encoder:
    """``spaced``: a word that follows a space is encoded with it (byte-level BPE); else white space is no token."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.plain = self.tokenizer
        normal = self.tokenizer.normalizer
        if normal and not spaced and all(normal.normalize_str(f"a{c}a") == f"a{c}a" for c in map(chr, set(_LOWER[:128].tolist())) if not c.isspace()):
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None  # leaves runs of lower-case ASCII as they are
        self.words = None if spaced else self._for_words(path)
        added = self.tokenizer.get_added_tokens_decoder()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # that each token spells
        for s, k in vocab.items():
            self.bytes[k] = len(added[k].content.encode()) if k in added else len(s.removesuffix("" if spaced else "</w>"))
        self.letters: dict[str, bool] = {}
        self.runs = _Table()

    def _for_words(self, path: str):  # noqa: ANN202
        """The library's tokenizer of this file without what does nothing to words of ``_LETTERS``: its normaliser, and its
        expression for words, in place of which it splits at white space; none if the file does something to them."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        if [x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", ())[:1]] != ["Split"]:
            return None
        made["normalizer"], made["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
        words, normal = Tokenizer.from_str(json.dumps(made)), self.tokenizer.normalizer
        text = " ".join(f" {c} a{c}a" for c in map(chr, range(ord("a"), 0x100)) if re.fullmatch(f"[{_LETTERS}]", c))
        normalised = " ".join(text.split())
        pieces = [[w for w, _ in t.pre_tokenizer.pre_tokenize_str(normalised)] for t in (words, self.tokenizer)]
        return words if pieces[0] == pieces[1] and (normal is None or normal.normalize_str(normalised) == normalised) else None

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letter(self, c: str) -> bool:
        """Whether the library takes a character, normalised, for letters."""
        if c not in self.letters:
            n = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            self.letters[c] = n != "" and len(self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + n)) == 1
        return self.letters[c]

    def _lengths(self, runs: pa.Array) -> np.ndarray:
        """Bytes that the tokens of each run spell."""
        if self.spaced:
            return pc.binary_length(runs).to_numpy().astype(np.int64)
        word = pc.ascii_trim_whitespace(runs)
        n = pc.binary_length(word).to_numpy().astype(np.int64)
        other = np.flatnonzero(~pc.string_is_ascii(word).to_numpy(zero_copy_only=False))
        if len(other):
            lower = unicodedata.normalize("NFC", " ".join(_strings(word.take(pa.array(other))))).lower()
            parts = lower.split(" ")
            if len(parts) != len(other) or len(lower.split()) != len(other):  # there is other white space in a run
                parts = ["".join(unicodedata.normalize("NFC", r).lower().split()) for r in _strings(word.take(pa.array(other)))]
            n[other] = pc.binary_length(pa.array(parts, pa.string())).to_numpy()
        return n

    def _learn(self, runs: pa.Array) -> np.ndarray:
        """Adds distinct runs; which of them each new place has.

        In a call each begins with a space or, where a space is part of tokens, ends at a line end.
        """
        order: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def alone(some: np.ndarray) -> None:
            got = [self._one(r) for r in _strings(runs.take(pa.array(some)))]
            order.append(some)
            rows.append(np.array([x for r in got for x in r], np.int32))
            sizes.append(np.array([len(r) for r in got], np.int64))

        def together(which: np.ndarray, tokenizer, before: str, after: str) -> None:  # noqa: ANN001
            places = np.flatnonzero(which)
            some = runs.take(pa.array(places))
            lengths = self._lengths(some)
            joined = pc.binary_join_element_wise(before, some, after, "")
            _, offsets, data = joined.buffers()
            offsets, data = np.frombuffer(offsets, np.int32, len(some) + 1, 4 * joined.offset).tolist() if len(some) else [0], memoryview(data or b"")
            for i in range(0, len(some), 64 * CALL):
                ends_at = [min(k, len(some)) for k in range(i, min(i + 64 * CALL, len(some)) + CALL, CALL)]
                calls = [(a, b) for a, b in zip(ends_at, ends_at[1:], strict=False) if a < b]
                got = tokenizer.encode_batch_fast([str(data[offsets[a] : offsets[b]], "utf-8") for a, b in calls], add_special_tokens=False)
                for (a, b), e in zip(calls, got, strict=True):
                    ids = np.array(e.ids, np.int32)
                    ends = np.concatenate(([0], np.cumsum(self.bytes[ids])))
                    n = lengths[a:b]
                    to = np.cumsum(n + len(after)) - len(after)
                    first, end = np.searchsorted(ends, to - n), np.searchsorted(ends, to)
                    if ends[-1] != to[-1] + len(after) or (ends[np.minimum(first, len(ends) - 1)] != to - n).any() or (ends[np.minimum(end, len(ends) - 1)] != to).any():
                        alone(places[a:b])  # some character changes its size
                        continue
                    n = end - first
                    order.append(places[a:b])
                    sizes.append(n)
                    rows.append(ids[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)])

        offsets, data = np.frombuffer(runs.buffers()[1], np.int32, len(runs) + 1, 4 * runs.offset), np.frombuffer(runs.buffers()[2], np.uint8)
        final, spaced = data[offsets[1:] - 1], data[offsets[:-1]] == 32
        white = _WHITE_END[final]
        white[final >= 0x80] = [r[-1].isspace() for r in _strings(runs.filter(pa.array(final >= 0x80)))]
        # a capital stays one before a character that is not ASCII
        plain = pc.and_(pc.string_is_ascii(runs), pc.equal(pc.ascii_lower(runs), runs)).to_numpy(zero_copy_only=False)
        words = np.zeros(len(runs), bool)
        if self.words:
            words |= pc.match_substring_regex(runs, f"^[ \\t-\\r]?[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        alone(np.flatnonzero(white))
        for which, tokenizer in ((words, self.words), (plain & ~white & ~words, self.plain), (~plain & ~white & ~words, self.tokenizer)):
            if self.spaced:
                together(which & spaced, tokenizer, "", "")
                together(which & ~spaced, tokenizer, "", "\n")
            else:
                together(which, tokenizer, " ", "")
        places = np.concatenate(order)
        self.runs.add(runs.take(pa.array(places)), rows, sizes)
        return places

    def _numbers(self, runs: pa.Array) -> np.ndarray:
        """Places of runs in the table, into which new ones go first."""
        no = pc.index_in(runs, value_set=self.runs.known)
        if no.null_count:
            unknown = no.is_null()
            missed = runs.filter(unknown).dictionary_encode()
            new = missed.dictionary
            if len(self.runs.known) + len(new) > RUNS and len(self.runs.known):
                self.runs = _Table()
                return self._numbers(runs)
            before = len(self.runs.known)
            place = np.empty(len(new), np.int32)
            place[self._learn(new)] = np.arange(before, before + len(new))
            out = no.fill_null(0).to_numpy().copy()
            out[unknown.to_numpy(zero_copy_only=False)] = place[missed.indices.to_numpy()]
            return out
        return no.to_numpy()

    def _cuts(self, buf: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
        """Where runs begin in the joined bytes of texts, which begin at ``begin``."""
        kind = _mapped(buf, _KIND)
        cut = np.zeros(size + 1, np.uint8)
        cut[1:size] = _mapped(kind[:-1] * np.uint8(8) + kind[1:], _CUT)
        edge = np.zeros(size + 1, bool)
        edge[begin] = edge[size] = True
        before_last = np.flatnonzero(cut == 2)
        after = before_last + 1
        cut[before_last] = ~edge[after] & (kind[np.minimum(after, size - 1)] != _WHITE) & (kind[np.minimum(after, size - 1)] != _SPACE)
        cut[edge] = 1
        cut[size] = 0
        wide = buf >= 0x80
        if wide.any():
            inner = np.flatnonzero(cut.view(bool)[1:size] & (wide[1:] | wide[:-1])) + 1
            # a cut beside white space needs no letter
            inner = inner[~edge[inner] & (kind[inner - 1] < _WHITE) & (kind[inner] < _WHITE)]
            cut[inner[~(self._letters(buf, inner, size, True) & self._letters(buf, inner, size, False))]] = 0
        return np.flatnonzero(cut.view(bool))

    def _letters(self, buf: np.ndarray, at: np.ndarray, size: int, before: bool) -> np.ndarray:
        """Whether the character before or after each place is ASCII or a letter."""
        b = [buf[np.clip(at - k - 1 if before else at + k, 0, size - 1)].astype(np.int64) for k in range(4)]
        if before:
            two, three = b[1] >= 0xC0, b[2] >= 0xE0
            key = np.where(two, b[1] << 8 | b[0], np.where(three, b[2] << 16 | b[1] << 8 | b[0], b[3] << 24 | b[2] << 16 | b[1] << 8 | b[0]))
        else:
            key = np.where(b[0] < 0xE0, b[0] << 8 | b[1], np.where(b[0] < 0xF0, b[0] << 16 | b[1] << 8 | b[2], b[0] << 24 | b[1] << 16 | b[2] << 8 | b[3]))
        key = np.where(b[0] < 0x80, 0, key)
        names, inverse = np.unique(key, return_inverse=True)
        return np.array([not n or self._letter(n.to_bytes(4, "big").lstrip(b"\0").decode()) for n in names.tolist()], bool)[inverse]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (one more at the end)."""
        array = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring(array, "<|")
        if self.spaced:
            odd = pc.or_(odd, pc.match_substring_regex(array, f"[{_RARE}]"))
        whole = odd.to_numpy(zero_copy_only=False)
        part = pc.if_else(odd, "", array) if whole.any() else array
        offsets = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, 4 * part.offset) if len(part) else np.zeros(1, np.int32)
        size = int(offsets[-1] - offsets[0])
        flat, counts = np.zeros(0, np.int32), np.zeros(len(array), np.int64)
        if size:
            buf = np.frombuffer(part.buffers()[2], np.uint8, size, int(offsets[0]))
            if not self.spaced:
                low = _mapped(buf, _LOWER)  # as its normaliser does; fewer distinct runs
                if (wide := np.flatnonzero(buf >= 0x80)).size:  # what follows may be a mark, with which a capital composes otherwise
                    low = low.copy()
                    low[wide - 1] = buf[wide - 1]
                buf = low
            begin = offsets - offsets[0]
            at = self._cuts(buf, begin[:-1][begin[:-1] < size], size)
            runs = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, size).astype(np.int32)), pa.py_buffer(buf))
            no = self._numbers(runs)  # may begin the table anew
            flat, n = self.runs.gather(no)
            counts = np.diff(np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, begin)])
        if whole.any():
            done, parts, lengths = 0, [], []
            split_at = np.cumsum(counts)
            for k in np.flatnonzero(whole).tolist():
                parts += [flat[done : split_at[k]], np.array(self._one(array[k].as_py()), np.int32)]
                done = split_at[k]
                lengths.append(len(parts[-1]))
            flat = np.concatenate([*parts, flat[done:]])
            counts[whole] = lengths
        return flat, np.concatenate(([0], np.cumsum(counts)))


_made: dict[str, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this Python worker, which later tasks of the worker use again."""
    if path not in _made:
        _made[path] = Encoder(path, spaced)
    return _made[path]


def release() -> None:
    """Lets go of this worker's encoders and gives their memory back, for stages of other kinds that the worker runs next."""
    import ctypes
    import gc

    _made.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
