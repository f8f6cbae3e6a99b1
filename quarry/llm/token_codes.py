"""Token-ID output as directly addressable codes (DAC).

Every id is split into chunks of ``width`` bits.  Level 0 holds the lowest
chunk of every id; a *continuation bitmap* beside it marks ids with more
bits, and level 1 holds the next chunk of those only, and so on.  A *rank
directory* counts the set bits before every block of 512, so the place of an
id's next chunk is one directory entry plus a popcount inside one block: any
token is read with a few small reads and no block is ever decoded.

File (little-endian, sections aligned to 8 bytes)::

    8 B  magic "QRYDAC1\\0"      u64 tokens, u64 documents, u64 width, u64 levels
    u64  [offset, bytes] of each section: document ids (i64), null flags (u8),
         document starts (u64, one more than documents), then for each level
         chunks (u8 or u16), bitmap (u8), rank directory (u64)

``write_tokens`` writes the shards; ``read_documents`` reads them back.
"""

from __future__ import annotations

import gc
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import (
    BATCH_ROWS,
    Output,
    attempt_name,
    batch_rows,
    partition_id,
    ragged,
    read_file,
    release_memory,
    shuffle_width,
    small_batches,
    staged,
    text_or_empty,
)
from quarry.session import scratch_path

MAGIC = b"QRYDAC1\0"
BLOCK = 512
END_ID = 2
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 150_000
MARKS = "".join(c for c in string.punctuation if c != "'")
MARKED = re.compile(r"(.+?)([!-&(-/:-@\[-`{-~]+)", re.S).fullmatch  # a word, then ASCII marks other than '
SHARD_SCHEMA = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- the codes
def split_levels(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chunk arrays and continuation flags of each level (at least one)."""
    if width not in (8, 16):
        raise ValueError("width must be 8 or 16 bits")
    kind, rest, out = (np.uint8 if width == 8 else np.uint16), ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(width)
        goes_on = more > 0
        out.append(((rest & np.uint32((1 << width) - 1)).astype(kind), goes_on))
        if not goes_on.any():
            return out
        rest = more[goes_on]


def rank_directory(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flags packed in whole blocks, and the set bits before each block."""
    blocks = -(-len(flags) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[: len(flags)] = flags
    per = padded.reshape(blocks, BLOCK).sum(axis=1, dtype=np.uint64) if blocks else np.zeros(0, np.uint64)
    return np.packbits(padded, bitorder="little"), np.concatenate([[np.uint64(0)], np.cumsum(per, dtype=np.uint64)])


def dump(doc_ids: list, lens: np.ndarray, ids: np.ndarray, width: int = 8) -> bytes:
    """The bytes of one shard."""
    levels = split_levels(ids, width)
    sections = [np.array([0 if d is None else d for d in doc_ids], "<i8"),
                np.array([d is None for d in doc_ids], "u1"),
                np.concatenate([[0], np.cumsum(lens)]).astype("<u8")]
    for chunks, flags in levels:
        sections += [chunks.astype("<u1" if width == 8 else "<u2"), *rank_directory(flags)]
    head, at, places, body = 8 + 4 * 8 + 16 * len(sections), 0, [], []
    at = head
    for s in sections:
        raw = s.tobytes()
        places += [at, len(raw)]
        pad = -len(raw) % 8
        body.append(raw + b"\0" * pad)
        at += len(raw) + pad
    return MAGIC + np.array([len(ids), len(doc_ids), width, len(levels), *places], "<u8").tobytes() + b"".join(body)


class Shard:
    """Random access to one shard.  ``read(offset, n)`` returns n bytes, from
    memory or as a ranged read of a remote file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read = read
        head = read(0, 40)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n_ids, self.n_docs, self.width, self.n_levels = (int(x) for x in np.frombuffer(head[8:40], "<u8"))
        self._at = np.frombuffer(read(40, 16 * (3 + 3 * self.n_levels)), "<u8").astype(np.int64).reshape(-1, 2)
        self._kind = np.dtype("<u1" if self.width == 8 else "<u2")

    @classmethod
    def of(cls, data: bytes) -> Shard:
        view = memoryview(data)
        return cls(lambda at, n: bytes(view[at: at + n]))

    def _part(self, section: int, kind, start: int, stop: int) -> np.ndarray:
        size, base = np.dtype(kind).itemsize, int(self._at[section, 0])
        return np.frombuffer(self._read(base + start * size, (stop - start) * size), kind)

    def documents(self) -> tuple[list, np.ndarray]:
        """Document ids (None where null) and starts (one more)."""
        ids, null = self._part(0, "<i8", 0, self.n_docs), self._part(1, "u1", 0, self.n_docs)
        return [None if z else int(d) for d, z in zip(ids, null)], self._part(2, "<u8", 0, self.n_docs + 1).astype(np.int64)

    def _flags(self, level: int, start: int, stop: int) -> np.ndarray:
        first = start // 8
        bits = np.unpackbits(self._part(4 + 3 * level, "u1", first, -(-stop // 8)), bitorder="little")
        return bits[start - 8 * first: stop - 8 * first].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        """Set bits of the level's bitmap before ``at``."""
        block = at // BLOCK
        return int(self._part(5 + 3 * level, "<u8", block, block + 1)[0]) + int(self._flags(level, block * BLOCK, at).sum())

    def ids(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids at [start, stop), without touching any other."""
        out = self._part(3 + 3 * level, self._kind, start, stop).astype(np.uint64)
        if start < stop and level + 1 < self.n_levels:
            flags = self._flags(level, start, stop)
            if flags.any():
                first = self._rank(level, start)
                out[flags] |= self.ids(first, first + int(flags.sum()), level + 1) << np.uint64(self.width)
        return out

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        return int(self.ids(i, i + 1)[0])


# ---------------------------------------------------------------- tokenizing
class WordTokenizer:
    """Ids of whole texts by a tokenizers file whose splitting never joins
    characters across an ASCII blank and which lower-cases (the public
    word-level BPE: blanks only separate).  Equal pieces between blanks then
    have equal ids wherever they stand, so each distinct piece is encoded
    once and looked up after.  Texts that may hold a special token's string
    (which would be matched before lower-casing) are encoded as they stand.
    The store of pieces ages: beyond ``CACHE_WORDS`` the half of it that stood in
    the most batches stays, with halved counts, and the rest is forgotten."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        suffix = getattr(self._tok.model, "end_of_word_suffix", None) or ""
        vocab = self._tok.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self._ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._code: dict[str, int] = {}
        self._flat, self._start, self._len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._seen = np.zeros(0, np.int32)  # batches each piece stood in

    def _age(self) -> None:
        """Forget the pieces that stood in the fewest batches."""
        kept = np.argsort(-self._seen, kind="stable")[: CACHE_WORDS // 2]
        kept = np.sort(kept[self._seen[kept] > 1])
        words, lens = list(self._code), self._len[kept]
        self._flat = self._flat[ragged(self._start[kept], lens)]
        self._start, self._len, self._seen = np.cumsum(lens) - lens, lens, self._seen[kept] >> 1
        self._code = {words[i]: code for code, i in enumerate(kept.tolist())}

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, each one pre-token.  ASCII words go
        straight to the model, as lower-casing and the byte mapping leave
        them alone; others are encoded as one text and parted at the tokens
        that end a word."""
        if words[0].isascii():
            got = [[t.id for t in self._tok.model.tokenize(w)] for w in words]
            return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)
        ids = np.array(self._tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self._ends[ids])
        if len(last) != len(words) or (len(ids) and last[-1] != len(ids) - 1):
            return self._ids(words)  # the tokenizer sees other letters than Python does
        return ids, np.diff(last, prepend=-1)

    def _store(self, words: list[str], flat: np.ndarray, n: np.ndarray) -> None:
        self._start = np.concatenate([self._start, len(self._flat) + np.cumsum(n) - n])
        self._len, self._flat = np.concatenate([self._len, n]), np.concatenate([self._flat, flat])
        self._seen = np.concatenate([self._seen, np.zeros(len(words), np.int32)])
        self._code.update(zip(words, range(len(self._code), len(self._code) + len(words))))

    def _learn(self, words: list[str]) -> None:
        """Store new pieces.  A piece of letters and then ASCII marks is two
        pre-tokens, so it has the ids of its two parts.  ASCII ones come
        parted already; these are the others."""
        known = self._code
        parts = {w: m.groups() for w in words if not w.isascii() and (m := MARKED(w)) and m[1].isalpha()}
        bare = dict.fromkeys([w for w in words if w not in parts] + [x for p in parts.values() for x in p])
        new = [w for w in bare if w not in known]
        plain = [w for w in new if w.isascii() and w.isalpha()]
        letters = [w for w in new if not w.isascii() and w.isalpha() and unicodedata.is_normalized("NFC", w) and w.lower().isalpha()]
        rest = list(dict.fromkeys(new) - dict.fromkeys(plain + letters).keys()) if len(plain) + len(letters) < len(new) else []
        for some, encode in ((plain, self._letters), (letters, self._letters), (rest, self._ids)):
            if some:
                self._store(some, *encode(some))
        if parts:
            codes = np.array([(known[a], known[b]) for a, b in parts.values()], np.int64).ravel()
            lens = self._len[codes]
            self._store(list(parts), self._flat[ragged(self._start[codes], lens)], lens.reshape(-1, 2).sum(axis=1))

    def _parted(self, pieces: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Each distinct piece as ASCII letters and the ASCII marks after
        them; any other piece as itself and nothing."""
        stems = pc.ascii_rtrim(pieces, MARKS)
        stems = pc.if_else(pc.ascii_is_alpha(stems), stems, pieces)
        whole, short = np.asarray(pc.binary_length(pieces), np.int64), np.asarray(pc.binary_length(stems), np.int64)
        start = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset: pieces.offset + len(pieces)].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        ends = np.concatenate([[0], np.cumsum(whole - short)]).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(ends), pa.py_buffer(data[ragged(start + short, whole - short)]))
        return stems.dictionary_encode(), tails.dictionary_encode()

    def _codes(self, distinct: list[str]) -> np.ndarray:
        new = [w for w in distinct if w not in self._code]
        if new:
            self._learn(new)
        code = np.fromiter(map(self._code.__getitem__, distinct), np.int64, len(distinct))
        self._seen[code] += 1
        return code

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each).  The
        cyclic collector rests meanwhile: pieces and tokens hold no cycles."""
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, end_id)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for s in self._special:
            odd |= np.asarray(pc.match_substring(texts, s, ignore_case=True))
        whole = dict(zip(np.flatnonzero(odd).tolist(), texts.filter(pa.array(odd)).to_pylist()))
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(odd), "", texts)))
        counts = np.diff(pieces.offsets.to_numpy())
        coded = pieces.flatten().dictionary_encode()
        if len(self._code) > CACHE_WORDS:
            self._age()
        parts = self._parted(coded.dictionary)
        both = np.stack([self._codes(p.dictionary.to_pylist())[p.indices.to_numpy()] for p in parts], axis=1).ravel()
        # the ids of the batch's own pieces, then those of its texts
        lens = self._len[both]
        own, lens = self._flat[ragged(self._start[both], lens)], lens.reshape(-1, 2).sum(axis=1)
        at = coded.indices.to_numpy()
        starts, lens = (np.cumsum(lens) - lens)[at], lens[at]
        flat = own[ragged(starts, lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)]
        per = np.diff(ends, prepend=0)
        if whole:
            ids, n = self._ids(list(whole.values()))
            at = np.fromiter(whole, np.int64)
            flat = np.insert(flat, np.repeat(ends[at], n), ids)
            per[at] = n
            ends = np.cumsum(per)
        if end_id is not None:
            flat, per = np.insert(flat, ends, np.uint32(end_id)), per + 1
        return flat, per


def _tokenizer(path: str, kept: dict = {}) -> WordTokenizer:  # noqa: B006 - one per Python worker
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


# ---------------------------------------------------------------- write, read
def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = END_ID, width: int = 8, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards to ``folder`` in
    ascending id order (null ids first; equal ids by their text's hash).
    Returns the manifest: one row per shard, in the order (part, seq).

    The texts are range-partitioned by id, so each task owns a run of ids and
    holds at most one shard of ids.  A file's name is the task attempt's own;
    only files of the manifest count, so a retried task is harmless.  A null
    or empty text has the end id alone; an empty table has no shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, name, part = _tokenizer(tokenizer_path), attempt_name(), partition_id()
        doc_ids: list = []
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        done, held = [], 0

        def flush() -> None:
            nonlocal doc_ids, lens, ids, held
            data = dump(doc_ids, np.concatenate(lens), np.concatenate(ids), width)
            out = Output(folder, f"ids-{name}-{len(done):05d}.dac")
            out.write(data)
            out.close()
            done.append((part, len(done), out.path, len(doc_ids), held, len(data)))
            doc_ids, lens, ids, held = [], [], [], 0

        for b in small_batches(batches, "_t", 1 << 20):
            flat, per = tok.encode(b.column("_t"), end_id)
            release_memory()  # else what encoding freed stays with the worker
            doc_ids += b.column("_id").to_pylist()
            lens.append(per)
            ids.append(flat)
            held += len(flat)
            if held >= shard_tokens:
                flush()
        if doc_ids:
            flush()
        names = ["part", "seq", "file", "n_docs", "n_ids", "n_bytes"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_t"))
    rows = rows.withColumn("_h", F.xxhash64("_t"))
    ordered = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return staged(ordered.select("_id", "_t").mapInArrow(run, SHARD_SCHEMA), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start (ids of all documents before it),
    n_tokens and the unsigned crc32 of its ids as little-endian uint32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard.of(read_file(row["file"]))
                docs, starts = shard.documents()
                crc = [zlib.crc32(shard.ids(int(a), int(z)).astype("<u4").tobytes()) for a, z in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts[:-1] + row["base"]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per shard of some million ids: the running sum is over files, not documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return files.repartition(shuffle_width(manifest.sparkSession)).mapInArrow(run, DOC_SCHEMA)


def tokens_round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the shards under the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "llm", "token-shards")
    return read_documents(write_tokens(docs, folder, tokenizer_path, **options))
