"""BPE encoding with forced boundaries, and decoding, of tokenizer files with word ends.

A merge joins two neighbouring pieces, so every pair of neighbouring characters
inside a token occurs inside that token of the vocabulary. A pair that occurs
inside no token is therefore a certain cut: no merge crosses it. Words are cut
there, each distinct fragment is encoded once by the merge ranks, and the ids are
concatenated. The result equals the tokenizers library's on the same file (its
normaliser and pre-tokeniser split texts beyond Latin script here as well).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import kept, list_column, runs, text_batches

WORD_BPE = "word_bpe_49k.json"
#: Strings whose ids a worker remembers in each of two generations.
REMEMBERED = 200_000
#: Characters of texts whose words are looked up and encoded together; a piece takes some 30 MB beside its ids.
TOGETHER = 1 << 19

#: The pattern of words that is worked out by the kinds of characters, and these kinds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER, LETTER, NUMBER, WHITE = range(4)
#: In texts of these characters, lower() and the pattern below do what the library does: they are in NFC and one to one.
_LATIN = regex.compile(r"[^\x00-\x1b\x20-ɏ]")


def byte_characters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Remembered(dict):
    """Values by key of a function of several keys; keeps what was asked for among the last keys, in two generations."""

    def __init__(self, function: Callable[[list[str]], Iterable[bytes]]):
        super().__init__()
        self.function, self.old = function, {}

    def of(self, keys: list[str]) -> list[bytes]:
        """The values of ``keys``; the function is called once, with the distinct keys that are not remembered."""
        values = [*map(self.get, keys)]
        missed = [i for i, v in enumerate(values) if v is None]
        if not missed:
            return values
        wanted = dict.fromkeys([keys[i] for i in missed])
        if len(self) + len(wanted) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        old = self.old
        wanted.update((k, old[k]) for k in wanted if k in old)
        new = [k for k, v in wanted.items() if v is None]
        wanted.update(zip(new, self.function(new), strict=True))
        self.update(wanted)
        for i in missed:
            values[i] = wanted[keys[i]]
        return values


def _strings(distinct: pa.Array) -> list[str]:
    return distinct.to_numpy(zero_copy_only=False).tolist()


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one behind the other, and the number of each entry's."""
    return np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _gathered(ids: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of a table, given as all their ids and the number of each entry's, in the same form."""
    first, many = (np.cumsum(n) - n)[which], n[which]
    upto = np.cumsum(many)
    place = np.repeat(first - upto + many, many)
    return ids[place + np.arange(len(place))], many


def _grouped(n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over groups of neighbours, given by the end of each group."""
    upto = np.concatenate([[0], np.cumsum(n)])
    return np.diff(upto[ends], prepend=0)


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizer file (BPE over byte characters with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}
        self.library = Tokenizer.from_file(path)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        white = r"\x09-\x0d\x20\x85\xa0"
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{white}\p{{L}}\p{{N}}]"))
        self.simple = pattern == PATTERN
        self.kinds = np.array([LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else WHITE if regex.match(f"[{white}]", c) else OTHER for c in map(chr, range(0x2C80))], np.uint8)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        bare = [t.removesuffix(self.suffix) if self.suffix else t for t in self.vocabulary]
        self.bytes = byte_characters()
        self.byte = byte = {c: i for i, c in enumerate(self.bytes)}
        #: by two neighbouring bytes: no token has them, so they are a certain cut
        self.cuts = np.ones((256, 256), bool)
        inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        known = np.array([(byte[p[0]], byte[p[1]]) for p in inside if p[0] in byte and p[1] in byte]).reshape(-1, 2)
        self.cuts[known[:, 0], known[:, 1]] = False
        self.written = np.array([ord(c) for c in self.bytes], "<u2")
        self.inner = Remembered(lambda parts: map(self.merge, parts))
        self.last = Remembered(lambda parts: map(self.merge_last, parts))

    def cut(self, words: list[str]) -> list[str]:
        """Each word in byte characters with a space at every forced boundary."""
        return self.cut_lines(words).split("\n")

    def cut_lines(self, words: list[str]) -> str:
        """The same as one string, a line for each word; one look at all neighbouring bytes."""
        flat = np.frombuffer("\n".join(words).encode(), np.uint8)
        signs = self.written[flat]
        signs[flat == 10] = 10  # byte characters are no white space: it parts words and fragments here
        here = self.cuts[flat[:-1], flat[1:]] & (signs[:-1] != 10) & (signs[1:] != 10)
        signs = np.insert(signs, np.flatnonzero(here) + 1, 32)
        return signs.tobytes().decode("utf-16-le")

    def merge(self, fragment: str) -> bytes:
        """The ids of one fragment without suffix: the pair of lowest rank is joined, the first one at ties, until none is left."""
        parts = list(fragment)
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            found = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return array("i", [self.vocabulary[p] for p in parts if p in self.vocabulary]).tobytes()

    def merge_last(self, fragment: str) -> bytes:
        """The ids of the fragment at a word's end: the library's merge loop appends the suffix."""
        return array("i", [t.id for t in self.library.model.tokenize(fragment)]).tobytes()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and how many each has; distinct fragments are looked up once."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        fragments = pc.split_pattern(pc.split_pattern(pa.array([self.cut_lines(words)], pa.large_string()), "\n").flatten(), " ")
        ends = np.cumsum(pc.list_value_length(fragments).to_numpy())
        flat = fragments.flatten()
        which, tables, before = np.zeros(len(flat), np.int64), [], 0
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        for mask, known in ((last, self.last), (~last, self.inner)):
            some = flat.filter(pa.array(mask)).dictionary_encode()
            tables += known.of(_strings(some.dictionary))
            which[mask] = some.indices.to_numpy() + before
            before = len(tables)
        ids, n = _gathered(*_joined(tables), which)
        return ids, _grouped(n, ends)

    def split(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all lower-cased texts, and behind how many words each text ends: what :data:`PATTERN` finds, by the kinds of neighbouring characters."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        inside = kind != WHITE
        here = ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)) & inside[1:] & inside[:-1]
        # an apostrophe behind no other sign may begin one of the endings, which is a word for itself
        tick = np.flatnonzero(points == 39)
        tick = tick[(tick == 0) | (kind[tick - 1] != OTHER)]
        behind = np.concatenate([points, [0, 0]])
        one, two = behind[tick + 1], behind[tick + 2]
        length = np.where(np.isin(one, [*map(ord, "stmd")]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            length[(one == ord(x)) & (two == ord(y))] = 3
        tick, length = tick[length > 0], length[length > 0]
        here[tick] = False
        stop = tick + length
        stop = stop[stop < len(points)]
        here[stop - 1] = inside[stop]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | here
        ends = np.cumsum([len(t) + 1 for t in texts])
        words = np.insert(points, np.flatnonzero(here) + 1, 32).tobytes().decode("utf-32-le").split()
        return pa.array(words, pa.large_string()).dictionary_encode(), np.searchsorted(np.flatnonzero(start), ends)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text without added special tokens; their own strings in a text are special, as in the library."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (see :meth:`encode`); each distinct string of a piece of texts is looked up once."""
        out: list[np.ndarray] = []
        for a, b in runs(texts, TOGETHER):
            plain = [t is not None and self.plain(t) for t in texts[a:b]]
            words, ends = self.split([t.lower() if p else "" for t, p in zip(texts[a:b], plain, strict=True)])
            ids, n = _gathered(*self.encode_words(_strings(words.dictionary)), words.indices.to_numpy())
            stop = np.cumsum(_grouped(n, ends)).tolist()
            for t, p, x, y in zip(texts[a:b], plain, [0, *stop], stop, strict=False):
                out.append(ids[x:y] if p else np.frombuffer(self.encode_other(t) if t else b"", np.int32))
        return out

    def plain(self, text: str) -> bool:
        """Whether lower() and the pattern do what the library does, and no special token is written in ``text``."""
        return self.simple and _LATIN.search(text) is None and (self.specials is None or "<|" not in text or self.specials.search(text) is None)

    def encode_other(self, text: str) -> bytes:
        """The ids of a text that :meth:`plain` refuses, with the library's normaliser and pre-tokeniser where they are needed."""
        out: list[bytes] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part and _LATIN.search(part) is None:  # no word of the pattern crosses white space
                words = self.pattern.findall(part.lower())
                out.append(self.encode_words(words)[0].tobytes())
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
                out.append(self.encode_words([bytes(map(self.byte.__getitem__, w)).decode() for w in words])[0].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        """What the library's decode gives for a file without decoder: the tokens joined by spaces, special ones included."""
        return " ".join([self.tokens[i] for i in ids])


def _loaded(name: str) -> ForcedBoundaryBPE:
    return kept(("bpe", name), lambda: ForcedBoundaryBPE(public_tokenizers.path(name)))


def encode_column(text, tokenizer: str = WORD_BPE):
    """A column array<int> of the ids of a text column; null and empty texts give an empty array."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(tokenizer)
        for batch in batches:
            yield pd.Series(bpe.encode_all(list(batch)), dtype=object)

    return F.pandas_udf(encode, "array<int>", F.PandasUDFType.SCALAR_ITER)(text)


def decode_column(ids, tokenizer: str = WORD_BPE):
    """A string column of decoded ids; null and empty arrays give an empty string."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(tokenizer)
        for batch in batches:
            yield pd.Series(["" if i is None else bpe.decode(i.tolist() if isinstance(i, np.ndarray) else i) for i in batch], dtype=object)

    return F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR_ITER)(ids)


def bpe_roundtrip(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """doc_id, ids and decoded text of each row of ``docs``; repeated rows each have one.

    Both directions run in one task over pieces of about 512 K characters, so a worker
    holds one piece's ids and one copy of the tables.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer)
        for batch, texts in text_batches(batches, TOGETHER, keeping=True):
            ids = bpe.encode_all(texts)
            decoded = pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(ids, pa.int32()), decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(both, "doc_id long, ids array<int>, decoded string")
