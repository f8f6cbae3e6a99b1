"""Alignment of two tokenizers and corpus counts of the id pairs they link.

A text's bytes (a space, then the text) are cut into tokens by a byte-level
BPE (A) and by a sentencepiece BPE (B).  Offsets where tokens of both end cut
the text into groups; an A and a B token are linked if their byte ranges
overlap.  A pair's count is the number of documents that hold it linked.

1. *Align*: a text is cut before every space that follows a character which
   isn't white space.  No token of either tokenizer crosses such a place and
   neither looks back over it (``Pair`` checks B's pieces), so equal units
   have equal tokens: each distinct unit of a shard is encoded and aligned
   once.  Shards (units, and documents as unit numbers) go to files in the
   shared folder; the pairs of a shard go to Spark, which keeps the distinct.
2. *Hash*: distinct pairs fall by hash into segments of some 65,536, a task
   each, which builds a minimal perfect hash: keys alone on a bit of a level
   keep it, the others go to the next level; a key's place is the rank of its
   bit.  The key stands at its place, so a look-up of a stranger is noticed.
3. *Count*: a task adds one for each (document, distinct pair) of its shards
   to dense vectors indexed by the hash, one for each segment, and a tree of
   grouped sums (first by segment and root-of-tasks salt) adds them up.
4. *Look up*: a second pass re-aligns every document from its units and
   looks up its links' counts and whether they are their A id's highest.

Segments are loaded when needed, the least used leave beyond a fixed number
of bytes, so memory depends on neither the corpus nor the number of pairs.
What the driver holds (a file name per segment, a number per A id) is bounded
by the vocabularies.

Defined cases: null and empty texts, and texts whose joined A or B bytes
differ from the bytes cut (U+2581 in a text, for instance), have no tokens:
zeros and ''.  Repeated rows are documents of their own; null ids are kept.
An empty table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import math
import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Output, attempt_name, partition_id, ragged, read_file, release_memory, shuffle_width, small_batches, staged
from quarry.llm.shingles import mix
from quarry.session import scratch_path

SHARD_BYTES = 24 << 20
SEGMENT_KEYS = 1 << 16
GAMMA = 2.0  # bits of a level for each key that enters it
CACHE_BYTES = 192 << 20  # of hash segments in a worker
VECTOR_BYTES = 128 << 20  # of count vectors a task holds before it hands them on
ENCODE_UNITS = 20_000
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---------------------------------------------------------------- tokenizers
def byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 letters stand for themselves,
    the other bytes for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[ids], self.lens[ids])]


class Pair:
    """The two tokenizers and the alignment of many units at once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocab = byte_of_letter(), self.a.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.a_words = Vocabulary(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second tokenizer crosses a space: units can't be encoded alone")
        self.b_words = Vocabulary([bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self._space = [i for i, p in enumerate(pieces) if p == "▁"]
        names = lambda v, end: [f"{i}{end}" for i in range(len(v.lens))]
        self._names = pa.array(names(self.a_words, ",") + names(self.a_words, "|") + names(self.b_words, ",") + names(self.b_words, ";") + names(self.b_words, ""))

    def align(self, units: pa.Array) -> pa.Table:
        """A row per unit (each begins with a space): ok, n_a, n_b, n_groups,
        links (A id * 2^32 + B id, by place), text (``a1,a2|b1;a3|b2``)."""
        return pa.concat_tables(self._align(units.slice(i, ENCODE_UNITS)) for i in range(0, len(units), ENCODE_UNITS))

    def _align(self, units: pa.Array) -> pa.Table:
        texts = units.to_pylist()
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = [x if len(t) > 1 else self._space for t, x in zip(texts, b)]  # a text's last space: alone, it would be the prefix of an empty text, which gets none
        raw = [t.encode() for t in texts]
        ok = np.ones(len(raw), bool)
        while True:  # once, or once more without the units that don't fit
            at = np.flatnonzero(ok)
            na, nb = np.array([len(a[i]) for i in at], np.int64), np.array([len(b[i]) for i in at], np.int64)
            ia, ib = (np.fromiter((x for i in at for x in ids[i]), np.int64) for ids in (a, b))
            size = np.array([len(raw[i]) for i in at], np.int64)
            la, lb = self.a_words.lens[ia], self.b_words.lens[ib]
            sums = lambda lens, n: np.diff(np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(n)])])
            wrong = (sums(la, na) != size) | (sums(lb, nb) != size) | (na == 0) | (nb == 0)
            if not wrong.any():
                whole = np.frombuffer(b"".join(raw[i] for i in at), np.uint8)
                unlike = (self.a_words.joined(ia) != whole) | (self.b_words.joined(ib) != whole)
                if not unlike.any():
                    break
                wrong[np.searchsorted(np.cumsum(size), np.flatnonzero(unlike), "right")] = True
            ok[at[wrong]] = False
        ends, ea, eb = np.cumsum(size), np.cumsum(la), np.cumsum(lb)
        cuts, both = np.union1d(ea, eb), np.intersect1d(ea, eb, assume_unique=True)
        links = (ia[np.searchsorted(ea, cuts)] << 32) | ib[np.searchsorted(eb, cuts)]
        n_links, n_groups = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (cuts, both))
        # tokens in the order of the text form: by group, A before B
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        per_a, per_b = (np.bincount(g, minlength=len(both)) for g in (ga, gb))
        order = np.empty(len(ia) + len(ib), np.int64)
        order[np.arange(len(ia)) + (np.cumsum(per_b) - per_b)[ga]] = ia + np.where(both[ga] == ea, len(self.a_words.lens), 0) if len(ia) else 0
        last = np.isin(eb, ends)
        order[np.arange(len(ib)) + np.cumsum(per_a)[gb]] = 2 * len(self.a_words.lens) + ib + len(self.b_words.lens) * ((both[gb] == eb).astype(np.int64) + last) if len(ib) else 0
        spread = lambda v: np.bincount(at, v, len(raw)).astype(np.int64)
        n_tokens, n_links = spread(na + nb), spread(n_links)
        listed = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
        return pa.table({"ok": ok, "n_a": spread(na), "n_b": spread(nb), "n_groups": spread(n_groups), "links": listed(n_links, pa.array(links)),
                         "text": pc.binary_join(listed(n_tokens, self._names.take(pa.array(order))), "")})


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in the joined bytes of texts that begin at ``starts``:
    there, and at every space after a character that isn't white space."""
    at = np.flatnonzero(data == 0x20)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))  # white space beyond ASCII, and some of its neighbours
    wide |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    cut = (at > 0) & (((one > 0x20) & (one < 0x7F)) | ((one >= 0x80) & ~wide))
    return np.union1d(at[cut], starts)


# ---------------------------------------------------------------- shards
def _pair(a_path: str, b_path: str, kept: dict = {}) -> Pair:  # noqa: B006 - one per Python worker
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Pair(a_path, b_path)
    return kept[a_path, b_path]


def _stream(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def shard(pair: Pair, ids: pa.Array, texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """(the shard's bytes, its distinct pairs)."""
    filled = pc.fill_null(texts, "")
    full = pc.not_equal(filled, "")
    joined = pc.binary_join_element_wise(pa.scalar(""), filled.filter(full), " ").cast(pa.string())
    n = len(joined)
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset: joined.offset + n + 1]
    begin = unit_starts(np.frombuffer(joined.buffers()[2], np.uint8)[: offsets[-1]], offsets[:-1]) if n else np.zeros(0, np.int64)
    places = np.append(begin, offsets[-1]).astype(np.int32) if n else np.zeros(1, np.int32)
    coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(places), joined.buffers()[2] if n else pa.py_buffer(b"")).dictionary_encode()
    code, of = coded.indices.to_numpy(), np.searchsorted(begin, offsets)
    units = pair.align(coded.dictionary) if len(begin) else pair.align(pa.array([" "])).slice(0, 0)
    ok = np.asarray(units["ok"])
    fits = np.bincount(np.repeat(np.arange(n), np.diff(of)), ~ok[code], n) == 0
    used = np.zeros(len(ok), bool)
    used[code[np.repeat(fits, np.diff(of))]] = True
    pairs = np.unique(np.asarray(pc.list_flatten(units["links"].filter(pa.array(used)))))
    whole = np.zeros(len(texts), bool)
    whole[np.flatnonzero(np.asarray(full))[fits]] = True
    lens = np.zeros(len(texts), np.int64)
    lens[whole] = np.diff(of)[fits]
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(code[np.repeat(fits, np.diff(of))].astype(np.int32)))
    docs = pa.table({"doc_id": ids, "units": listed})
    head = _stream(units.drop_columns(["ok"]))
    return len(head).to_bytes(8, "little") + head + _stream(docs), pairs


def read_shard(path: str) -> tuple[pa.Table, pa.Table]:
    """(units, documents): a document without tokens has no units."""
    data = read_file(path)
    n = int.from_bytes(data[:8], "little")
    units, docs = (pa.ipc.open_stream(pa.py_buffer(data).slice(at, size)).read_all() for at, size in ((8, n), (8 + n, len(data) - 8 - n)))
    return units.combine_chunks(), docs.combine_chunks()


def write_shards(docs: DataFrame, folder: str, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Align every text, write shards and return their staged manifest: file,
    pairs (the distinct ones of the shard).  Files are the task attempt's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, name, done, held, size = _pair(a_path, b_path), attempt_name(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal done, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            data, pairs = shard(pair, rows["id"].combine_chunks(), rows["t"].combine_chunks())
            out = Output(folder, f"aligned-{name}-{done:05d}.bin")
            out.write(data)
            out.close()
            done, held, size = done + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([out.path]), pa.array([pairs], pa.list_(pa.int64()))], ["file", "pairs"])

        for b in small_batches(batches, "t", shard_bytes // 4):
            held.append(b)
            size += b.column("t").nbytes
            if size >= shard_bytes * 3 // 4:
                yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return staged(rows.mapInArrow(run, "file string, pairs array<long>"), "aligned-shards")


# ---------------------------------------------------------------- minimal perfect hash
class PerfectHash:
    """Distinct keys to 0 .. n - 1, checked by the stored keys."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        self.ranks = []
        start = 0
        for bits in levels:
            per = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(start + np.cumsum(per) - per)
            start += int(per.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        levels, rest = [], np.unique(keys)
        keys, places = rest, []
        while len(rest):
            size = 64 * max(1, math.ceil(gamma * len(rest) / 64))
            at = cls._at(rest, len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            levels.append(np.packbits(np.bincount(at[alone], minlength=size).astype(bool), bitorder="little").view(np.uint64))
            places.append(rest[alone][np.argsort(at[alone])])
            rest = rest[~alone]
        return cls(levels, np.concatenate([keys[:0], *places]))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64), 100 + level) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 of a key that wasn't among those hashed."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._at(keys[open_], level, 64 * len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, **{f"level{i}": x for i, x in enumerate(self.levels)}, **more)
        return out.getvalue()


class Segments:
    """The segments' files, loaded when needed; the least used leave first."""

    def __init__(self, files: dict[int, str], cache_bytes: int = CACHE_BYTES):
        self.files, self.limit, self.held, self.size = files, cache_bytes, OrderedDict(), 0

    def of(self, keys: np.ndarray) -> np.ndarray:
        return segment_of(keys, len(self.files))

    def get(self, segment: int) -> tuple[PerfectHash, np.ndarray | None]:
        if segment in self.held:
            self.held.move_to_end(segment)
            return self.held[segment][:2]
        data = read_file(self.files[segment])
        with np.load(io.BytesIO(data)) as z:
            found = PerfectHash([z[f"level{i}"] for i in range(sum(n.startswith("level") for n in z.files))], z["keys"]), z["counts"] if "counts" in z.files else None
        self.held[segment] = (*found, len(data))
        self.size += len(data)
        while self.size > self.limit and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1][2]
        return found

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, PerfectHash, np.ndarray | None]]:
        """(segment, which of the keys, their places, hash, counts); every key
        must have been hashed."""
        segment = self.of(keys)
        order = np.argsort(segment, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1):
            if len(some):
                s = int(segment[some[0]])
                hashed, counts = self.get(s)
                at = hashed.index(keys[some])
                if (at < 0).any():
                    raise ValueError("a pair of the second pass was not among those hashed")
                yield s, some, at, hashed, counts


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64), 99) % np.uint64(n)).astype(np.int64)


def hash_pairs(manifest: DataFrame, folder: str, segment_keys: int = SEGMENT_KEYS) -> dict[int, str]:
    """Build the segments' hashes; the file of each segment."""
    pairs = staged(manifest.select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    n = max(1, math.ceil(pairs.count() / segment_keys))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(np.asarray(b.column("pair")), n)), b.column("pair")], ["segment", "pair"])

    def build(rows: pa.Table) -> pa.Table:
        s = rows["segment"][0].as_py()
        return _segment_file(folder, "hash", s, PerfectHash.build(np.asarray(rows["pair"])).dump())

    files = pairs.mapInArrow(number, "segment long, pair long").groupBy("segment").applyInArrow(build, "segment long, file string")
    found = {r["segment"]: r["file"] for r in staged(files, "segments").collect()}  # bounded by the vocabularies' product
    for s in set(range(n)) - found.keys():  # a segment no pair fell into is never asked for
        found[s] = ""
    return found


def _segment_file(folder: str, kind: str, segment: int, data: bytes) -> pa.Table:
    out = Output(folder, f"{kind}-{segment:07d}-{attempt_name()}.npz")
    out.write(data)
    out.close()
    return pa.table({"segment": pa.array([segment], pa.int64()), "file": [out.path]})


# ---------------------------------------------------------------- counts
def _files(manifest: DataFrame) -> DataFrame:
    return manifest.select("file").repartition(shuffle_width(manifest.sparkSession))


def document_counts(units: pa.Table, docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs, how many of the documents hold each)."""
    link_at = units["links"].chunk(0).offsets.to_numpy().astype(np.int64) if units.num_rows else np.zeros(1, np.int64)
    keys, code = np.unique(np.asarray(pc.list_flatten(units["links"])), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    listed, step = docs["units"].chunk(0) if docs.num_rows else None, max(1, 1 << 20)
    at, lens = 0, np.asarray(pc.list_value_length(docs["units"]), np.int64)
    ends = np.cumsum(lens)
    while at < len(lens):  # some million units at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        flat = np.asarray(listed.slice(at, to - at).flatten(), np.int64)
        own = np.unique(np.repeat(np.arange(to - at), lens[at:to]) * max(1, units.num_rows) + flat)
        doc, unit = np.divmod(own, max(1, units.num_rows))
        n = link_at[unit + 1] - link_at[unit]
        held = np.unique(np.repeat(doc, n) * max(1, len(keys)) + code[ragged(link_at[unit], n)])
        counts += np.bincount(held % max(1, len(keys)), minlength=len(keys))
        at = to
    return keys[counts > 0], counts[counts > 0]


def count_pairs(manifest: DataFrame, folder: str, files: dict[int, str]) -> tuple[dict[int, str], np.ndarray]:
    """(the file of each segment with its counts, the highest count of each A id)."""
    tasks = shuffle_width(manifest.sparkSession)
    salts = math.isqrt(tasks) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, vectors, salt = Segments(files), {}, partition_id() % salts

        def flush() -> Iterator[pa.RecordBatch]:
            for s, v in vectors.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([salt], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["segment", "salt", "counts"])
            vectors.clear()

        for b in batches:
            for path in b.column("file").to_pylist():
                keys, counts = document_counts(*read_shard(path))
                for s, some, at, hashed, _ in segments.parts(keys):
                    if s not in vectors:
                        vectors[s] = np.zeros(len(hashed.keys), np.int64)
                    vectors[s][at] += counts[some]
                if sum(v.nbytes for v in vectors.values()) > VECTOR_BYTES:
                    yield from flush()
        yield from flush()
        release_memory()

    def added(rows: pa.Table) -> np.ndarray:
        total = np.frombuffer(rows["counts"][0].as_buffer(), np.int64).copy()
        for v in rows["counts"][1:]:
            total += np.frombuffer(v.as_buffer(), np.int64)
        return total

    def branch(rows: pa.Table) -> pa.Table:
        return pa.table({"segment": rows["segment"][:1], "counts": pa.array([added(rows).tobytes()], pa.binary())})

    def root(rows: pa.Table) -> pa.Table:
        s, counts = rows["segment"][0].as_py(), added(rows)
        hashed = Segments(files).get(s)[0]
        a = hashed.keys >> 32
        ids, at = np.unique(a, return_inverse=True)
        top = np.zeros(len(ids), np.int64)
        np.maximum.at(top, at, counts)
        done = _segment_file(folder, "counts", s, hashed.dump(counts=counts))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(top))
        return done.append_column("a", pa.chunked_array([lists[0]])).append_column("top", pa.chunked_array([lists[1]]))

    parts = _files(manifest).mapInArrow(count, "segment long, salt int, counts binary")
    parts = parts.groupBy("segment", "salt").applyInArrow(branch, "segment long, counts binary")
    summed = staged(parts.groupBy("segment").applyInArrow(root, "segment long, file string, a array<long>, top array<long>"), "pair-counts")
    found = files | {r["segment"]: r["file"] for r in summed.select("segment", "file").collect()}
    tops = summed.select(F.explode(F.arrays_zip("a", "top")).alias("x")).groupBy("x.a").agg(F.max("x.top").alias("top")).collect()  # a number per id of A
    highest = np.zeros(max((r["a"] for r in tops), default=0) + 1, np.int64)
    for r in tops:
        highest[r["a"]] = r["top"]
    return found, highest


# ---------------------------------------------------------------- second pass
def joined_sha256(text: pa.Array, places: np.ndarray, step: int = 1 << 20) -> str:
    """SHA-256 of the strings at the places, joined by ``;``; '' of none."""
    if not len(places):
        return ""
    sha = hashlib.sha256()
    for i in range(0, len(places), step):
        sha.update((";" * (i > 0) + ";".join(text.take(pa.array(places[i: i + step])).to_pylist())).encode())
    return sha.hexdigest()


def look_up(manifest: DataFrame, files: dict[int, str], highest: np.ndarray) -> DataFrame:
    """A row per document of the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(files)
        for b in batches:
            for path in b.column("file").to_pylist():
                yield from rows(segments, *read_shard(path))
        release_memory()

    def rows(segments: Segments, units: pa.Table, docs: pa.Table) -> Iterator[pa.RecordBatch]:
        if not docs.num_rows:
            return
        links = np.asarray(pc.list_flatten(units["links"]))
        keys, code = np.unique(links, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        asked = np.zeros(len(keys), bool)
        n_links = np.asarray(pc.list_value_length(units["links"]), np.int64)
        used = np.zeros(units.num_rows, bool)
        used[np.asarray(pc.list_flatten(docs["units"]))] = True
        asked[code[np.repeat(used, n_links)]] = True
        which = np.flatnonzero(asked)
        for _, some, at, _, found in segments.parts(keys[which]):
            counts[which[some]] = found[at]
        best = asked & (counts == highest[np.minimum(keys >> 32, len(highest) - 1)])
        ends = np.cumsum(n_links)
        per_unit = lambda v: (x := np.concatenate([[0], np.cumsum(v[code], dtype=np.int64)]))[ends] - x[ends - n_links]
        numbers = [np.asarray(units[c], np.int64) for c in ("n_a", "n_b", "n_groups")] + [n_links, per_unit(best.astype(np.int64)), per_unit(counts)]
        text, listed = units["text"].combine_chunks(), docs["units"].combine_chunks()
        lens = np.asarray(pc.list_value_length(listed), np.int64)
        until, at = np.cumsum(lens), 0
        while at < len(lens):
            to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + (1 << 20), "right")))
            part = listed.slice(at, to - at)
            flat = np.asarray(part.flatten(), np.int64)
            stop = np.cumsum(lens[at:to])
            sums = [(x := np.concatenate([[0], np.cumsum(v[flat])]))[stop] - x[stop - lens[at:to]] for v in numbers]
            if to - at == 1:  # it may be long
                shas = [joined_sha256(text, flat)]
            else:
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), text.take(pa.array(flat))), ";")
                shas = [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(joined, lens[at:to])]
            yield pa.RecordBatch.from_arrays([docs["doc_id"].combine_chunks().slice(at, to - at), *(pa.array(s) for s in sums), pa.array(shas, pa.string())],
                                             [c.split()[0] for c in OUT.split(", ")])
            at = to

    return _files(manifest).mapInArrow(run, OUT)


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """Per document: its tokens, groups and links, how many links are their A
    id's commonest, and the sum of the links' counts."""
    folder = scratch_path(docs.sparkSession, "llm", "alignment")
    manifest = write_shards(docs, folder, a_path, b_path, id_col=id_col, text_col=text_col, shard_bytes=shard_bytes)
    files, highest = count_pairs(manifest, folder, hash_pairs(manifest, folder, segment_keys))
    return look_up(manifest, files, highest)
