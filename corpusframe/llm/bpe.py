"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a block of texts are laid out as symbols in one flat array. In a round, the pairs of
neighbouring symbols are looked up in the sorted pair keys by binary search; in each word the pair of the
lowest rank is merged at all its places, from left to right, in all words at once; the array is packed and
the next round begins, over the words that changed. The rounds end when no pair has a rank. Decoding is a
gather: the bytes of every id, concatenated.

Tables come from a ``tokenizer.json`` whose path is a parameter. It is read on the driver and sent to the
tasks; it must be a plain byte-level BPE with the usual split pattern (checked).

Texts are processed in blocks of bounded size, so a task's memory follows the longest text, not its share
of the rows. A row is independent of all others: no shuffle, and nothing to skew.
"""

from __future__ import annotations

import hashlib
import json
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm.common import ship
from corpusframe.llm.textblocks import BLOCK, ranges, string_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The split pattern of byte-level BPE. A fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merge and byte tables of a byte-level BPE file."""

    def __init__(self, text: str):
        d = json.loads(text)
        pre, model = d["pre_tokenizer"], d["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or d.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        ids = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.byte_id = np.array([ids[c] for c in byte_characters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_key, self.pair_rank = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.special = {}
        for t in d["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.special[t["content"]] = t["id"]
        n = max([*ids.values(), *self.special.values()]) + 1
        piece = [b""] * n
        for s, i in [*ids.items(), *self.special.items()]:
            piece[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.piece_size = np.array([len(p) for p in piece], dtype=np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_size)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(piece), dtype=np.uint8)
        self.classes = character_classes()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        none = len(self.merged)
        rank = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            live = best < none
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, best = sym[live], word[live], rank[live], best[live]
                if not len(sym):
                    break
            hit = rank == best
            # of places that overlap (the same symbol in a row) every second one, from the left
            run = np.concatenate([[False], hit[:-1]]) & hit
            if run.any():
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~run, place, 0))
                hit &= (place - begin) % 2 == 0
            sym = np.where(hit, self.merged[np.minimum(best, none - 1)], sym)
            stay = ~np.concatenate([[False], hit[:-1]])
            sym, word, rank, hit = sym[stay], word[stay], rank[stay], hit[stay]
            # only the pairs that a new symbol is part of have another rank now
            fresh = hit.copy()
            fresh[:-1] |= hit[1:]
            fresh = np.flatnonzero(fresh)
            rank[fresh] = self._ranks(sym, word, fresh)
        if not done_sym:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place in ``at``; the number of merges where there is none."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] << 32 | sym[after]
        found = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((after > at) & (word[after] == word[at]) & (self.pair_key[found] == key), self.pair_rank[found], len(self.merged))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other."""
        size = self.piece_size[ids]
        n = int(size.sum())
        shift = np.repeat(self.piece_start[ids] - (np.cumsum(size) - size), size)
        return self.piece_bytes[np.arange(n) + shift].tobytes()


def character_classes() -> np.ndarray:
    """Class of every code point for the split pattern: 0 white space, 1 letter, 2 number, 3 other."""
    import regex
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 3, dtype=np.uint8)
    for code, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a:b + 1] = code
    return out


def token_starts(cp: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the split pattern begins a word. ``first`` marks the first character of each text (or part of one)."""
    new = first.copy()
    new[1:] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], len(cp))
    kind = cls[run]
    start = new
    follows = np.append(~first[run[1:]], False)  # the next run belongs to the same text
    # white space before a word: its last character stands alone, or goes with the word if it is a space
    gap = np.flatnonzero((kind == 0) & follows)
    last = end[gap] - 1
    start[last] = True
    joined = last[cp[last] == 32] + 1
    start[joined] = False
    # an apostrophe that begins a word and a short ending
    quote = np.flatnonzero((kind[:-1] == 3) & (kind[1:] == 1) & follows[:-1] & (end[:-1] - run[:-1] == 1)) if len(run) > 1 else np.empty(0, np.int64)
    quote = quote[(cp[run[quote]] == 39) & start[run[quote]]]
    q, stop = run[quote + 1], end[quote + 1]
    one = np.isin(cp[q], [ord(c) for c in "stmd"])
    second = cp[np.minimum(q + 1, len(cp) - 1)]
    two = ~one & (stop - q > 1) & (((cp[q] == ord("r")) | (cp[q] == ord("v"))) & (second == ord("e")) | (cp[q] == ord("l")) & (second == ord("l")))
    start[q[one | two]] = False
    rest = np.concatenate([q[one & (stop - q > 1)] + 1, q[two & (stop - q > 2)] + 2])
    start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes blocks of texts that lie one after the other as UTF-8 bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.weight = np.random.default_rng(1).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _hash(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of every word, and the place of every byte in its word."""
        place = np.arange(len(data)) - np.repeat(start, size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        return np.add.reduceat(self.weight[data] * power[place], start), place

    def encode_block(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each). ``ends``: where each text ends in ``data``."""
        v, n_texts = self.v, len(ends)
        if not len(data):
            return np.empty(0, np.int64), np.zeros(n_texts, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte at which each character begins
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        cls = v.classes[cp]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[0] = True
        first[ends] = True
        special = {}
        for text, i in v.special.items():
            key, p = text.encode(), data.find(text.encode())
            while p >= 0:
                # a string across the seam of two texts is none
                if not first[p + 1:p + len(key)].any():
                    special[p] = (len(key), i)
                p = data.find(key, p + len(key))
        for p, (n, _) in special.items():
            first[[p, p + n]] = True
        first = first[at]
        if special:
            for p, (n, _) in special.items():
                c = np.searchsorted(at, p)
                cls[c:c + n] = 4
        start = at[token_starts(cp, cls, first)]
        size = np.diff(np.append(start, len(raw)))
        h, place = self._hash(raw, start, size)
        _, rep, word = np.unique(h, return_index=True, return_inverse=True)
        # equal hashes must be equal words; one that is not is encoded for itself
        same_size = size[rep[word]] == size
        other = np.minimum(np.repeat(start[rep[word]], size) + place, len(raw) - 1)
        wrong = ~same_size | (np.add.reduceat((raw[other] != raw).astype(np.int32), start) > 0)
        if wrong.any():
            odd = np.flatnonzero(wrong)
            word[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        w_ids, w_size = v.encode_words([data[a:a + n] for a, n in zip(start[rep].tolist(), size[rep].tolist())])
        w_start = np.cumsum(w_size) - w_size
        if special:
            mine = {int(np.searchsorted(start, p)): i for p, (_, i) in special.items()}
            extra = np.array(list(mine.values()))
            word[list(mine)] = len(w_size) + np.arange(len(mine))
            w_ids, w_start = np.concatenate([w_ids, extra]), np.concatenate([w_start, len(w_ids) + np.arange(len(mine))])
            w_size = np.concatenate([w_size, np.ones(len(mine), np.int64)])
        n = w_size[word]
        ids = w_ids[np.arange(int(n.sum())) + np.repeat(w_start[word] - (np.cumsum(n) - n), n)]
        total = np.concatenate([[0], np.cumsum(n)])
        upto = total[np.searchsorted(start, ends)]
        return ids, np.diff(np.concatenate([[0], upto]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        ids, n = self.encode_block(b"".join(raw), np.cumsum([len(r) for r in raw]))
        return np.split(ids, np.cumsum(n)[:-1])


def _digest(ids: np.ndarray, v: Vocabulary) -> tuple:
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(v.decode(ids).decode("utf-8", "replace").encode()).hexdigest()


def _tables(spark: SparkSession, vocabulary_file: str):
    """The tables of a vocabulary file, sent to the tasks once; their size is the file's."""
    with open(vocabulary_file, encoding="utf-8") as f:
        return ship(spark, Vocabulary(f.read()))


def encode(docs: DataFrame, vocabulary_file: str, text: str = "text", ids: str | None = "ids", digest: bool = True, block: int = BLOCK) -> DataFrame:
    """``docs`` with its tokens: ``ids`` (array of int), n_tokens, ids_sha256 and decoded_sha256.

    ``ids=None`` leaves the array out, ``digest=False`` the digests. Input columns of these names are
    replaced. A null text is encoded as an empty one (no tokens); strings of special tokens inside a
    text become these tokens. Every row is kept, repeated rows too.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    made = [T.StructField("n_tokens", T.LongType())]
    made += [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    made += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest else []
    taken = {f.name for f in made}
    own = [f for f in docs.schema.fields if f.name not in taken]
    # the text travels under a name of its own, as it may be a column that is replaced
    source = docs.select(*[F.col(f"`{f.name}`") for f in own], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    tables = _tables(docs.sparkSession, vocabulary_file)

    def run(batches):
        v = tables.value
        e = Encoder(v)
        for batch in batches:
            data, offsets = string_bytes(batch.column(batch.num_columns - 1))
            for a, b in ranges(np.diff(offsets), block):
                got, n = e.encode_block(bytes(data[offsets[a]:offsets[b]]), offsets[a + 1:b + 1] - offsets[a])
                part, upto = batch.slice(a, b - a), np.concatenate([[0], np.cumsum(n)])
                cols = [part.column(i) for i in range(batch.num_columns - 1)] + [pa.array(n, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(got, pa.int32())))
                if digest:
                    d = [_digest(got[x:y], v) for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())]
                    cols += [pa.array([x for x, _ in d], pa.string()), pa.array([y for _, y in d], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *[f.name for f in made]])

    return source.mapInArrow(run, T.StructType(own + made))


def decode(rows: DataFrame, vocabulary_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of its ids in ``out``; null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    own = [f for f in rows.schema.fields if f.name != out]
    source = rows.select(*[F.col(f"`{f.name}`") for f in own], F.col(f"`{ids}`").cast("array<int>").alias("__ids"))
    tables = _tables(rows.sparkSession, vocabulary_file)

    def run(batches):
        v = tables.value
        for batch in batches:
            got = [v.decode(np.asarray(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(got, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], out])

    return source.mapInArrow(run, T.StructType(own + [T.StructField(out, T.StringType())]))


def default_file(spark: SparkSession | None = None) -> str:
    """The public byte-level vocabulary that the test machines carry."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
