"""Removal of passages that stand in earlier documents, by suffix trees.

A window is ``words`` consecutive words of a document; a word goes if some
window over it also stands in a document with a smaller id.  All windows are
judged on the input.

1. *Files*: texts (words parted by one space) go to files of some megabytes
   in the shared folder; later steps read a file where they need its words, so
   no text is shuffled.  Documents of equal words are judged once: the least
   id's rows stay, in the others every word is covered by a repeated window.
2. *Candidates*: a window's anchor is the least hash of its runs of
   ``2/5 words`` words.  Equal windows have equal anchors, so only suffixes
   whose first window has an anchor that another row has too can repeat.
3. *Prefixes*: a suffix's first ``words`` words are four blocks, the edges of
   the tree.  Suffixes are dealt to tasks by a prefix of variable length: one
   block, and a block more wherever a prefix has more than ``group`` suffixes,
   so the suffixes of a prefix always fit in memory.  Equal suffixes of a
   file travel once.  Suffixes that are too many even as a whole are one
   node, whose least document is a grouped minimum.
4. *Subtrees*: a task sorts its suffixes and builds their tree as intervals of
   common prefix lengths.  Its deep internal nodes (``words`` words) are
   the repeats; every file that isn't the least document's gets its share
   back.  The tree is cut at that depth: a longer repeat is a chain of suffixes.
5. *Cut*: each file's repeats are looked up among its windows and the words
   they cover are left out.

Words are compared by 64-bit hashes, a block by the hash of its words, so a
node compares 256 bits.

Defined cases: a null text has no words; a document with fewer words than a
window keeps all.  A null id takes part in nothing.  Rows of one id take
nothing from one another, repeated rows all lose the same words.  An empty
table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Output, attempt_name, partition_id, read_file, release_memory, shuffle_width, small_batches, staged
from quarry.llm.shingles import mix
from quarry.session import scratch_path

WORDS = 50
BLOCKS = 4
GROUP = 1 << 17
FILE_BYTES = 8 << 20
FILE_DOCS = 1 << 16
STEP = 1 << 20  # windows at once
PLACE_BITS = 40  # of a word's place in its document, with a flag
EDGES = [f"b{k}" for k in range(1, BLOCKS + 1)]
ROW = "fid long, file string, idx int, doc_id long, n_words long, sha binary"
OUT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
_U = np.uint64
_BASE = _U(0xD1342543DE82EF95)  # odd


# ---------------------------------------------------------------- files
def write_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the texts to files; a staged row per document: its file and place
    there, id, number of words and the SHA-256 of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, done = attempt_name(), 0
        for b in small_batches(batches, "t", file_bytes):
            for at in range(0, b.num_rows, FILE_DOCS):
                part = b.slice(at, FILE_DOCS)
                found = [(t or "").encode().split() for t in part.column("t").to_pylist()]
                texts = [b" ".join(w) for w in found]
                out = Output(folder, f"words-{name}-{done:05d}.arrow")
                out.write(_stream(pa.table({"text": pa.array([t + b" " if t else b"" for t in texts], pa.large_binary())})))
                out.close()
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition_id() << 24 | done] * n, pa.int64()), pa.array([out.path] * n), pa.array(range(n), pa.int32()), part.column("id"),
                     pa.array([len(w) for w in found], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                    [c.split()[0] for c in ROW.split(", ")])
                done += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return staged(rows.mapInArrow(run, ROW), "word-files")


def _stream(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def judged_files(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """A staged row per file: fid, file, docs (idx, doc_id, n_words, state:
    1 judged by its windows, 2 equal to an earlier document and so all gone,
    0 left as it is)."""
    long = F.col("doc_id").isNotNull() & (F.col("n_words") >= words)
    firsts = rows.filter(long).groupBy("sha").agg(F.min("doc_id").alias("_first"))
    state = F.when(~long, 0).when(F.col("doc_id") == F.col("_first"), 1).otherwise(2)
    of = rows.join(firsts, "sha", "left").select("fid", "file", F.struct("idx", "doc_id", "n_words", state.alias("state")).alias("d"))
    return staged(of.groupBy("fid", "file").agg(F.collect_list("d").alias("docs")), "judged-files")


class Words:
    """The words of a file's documents: bytes, starts and 64-bit hashes."""

    def __init__(self, path: str, words: int):
        texts = pa.ipc.open_stream(pa.py_buffer(read_file(path))).read_all()["text"].combine_chunks()
        self.size = words
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        ends = np.flatnonzero(self.data == 0x20) + 1  # every word is followed by one space
        self.starts = np.concatenate([[0], ends]).astype(np.int64)
        self.first = np.searchsorted(ends, offsets, "right")  # of each document; one more at the end
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(self.starts), texts.buffers()[2] or pa.py_buffer(b"")])
        coded = array.dictionary_encode()
        distinct = np.fromiter((xxhash.xxh3_64_intdigest(x.as_buffer()) for x in coded.dictionary), np.uint64, len(coded.dictionary))
        self.hashes = distinct[coded.indices.to_numpy()] if len(ends) else distinct

    def chunks(self, judged: np.ndarray) -> Iterator[Chunk]:
        """Runs of windows of the judged documents (a flag for each)."""
        n = np.diff(self.first)
        doc = np.repeat(np.arange(len(n)), n)
        left = np.repeat(self.first[1:], n) - np.arange(len(doc))
        starts = judged[doc] & (left >= self.size)
        for at in range(0, len(doc), STEP):
            here = np.flatnonzero(starts[at: at + STEP])
            if len(here):
                yield Chunk(self.hashes[at: at + STEP + self.size - 1], here, at, doc[at + here], self.size)


class Chunk:
    """Windows at some places of a run of words."""

    def __init__(self, hashes: np.ndarray, here: np.ndarray, at: int, doc: np.ndarray, size: int):
        n, self.size, self.here, self.at, self.doc = len(hashes), size, here, at, doc
        steps = np.full(n, _BASE, np.uint64)
        steps[:1] = 1
        powers = np.cumprod(steps, dtype=np.uint64)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
        steps[1:] = _U(pow(int(_BASE), -1, 1 << 64))
        self._inverse = np.cumprod(steps, dtype=np.uint64)

    def runs(self, at: np.ndarray, n: int, salt: int) -> np.ndarray:
        """Hashes of the n words from each place on."""
        return mix((self._sums[at + n] - self._sums[at]) * self._inverse[at], salt)

    def anchors(self) -> np.ndarray:
        """The anchor of every window."""
        run = max(1, 2 * self.size // 5)
        least = self.runs(np.arange(len(self._inverse) - run + 1), run, 40)
        width, span = self.size - run + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        return np.minimum(least[self.here], least[self.here + width - span])

    def blocks(self, which: np.ndarray) -> np.ndarray:
        """The edges' hashes of some windows, a row each."""
        cuts = [self.size * k // BLOCKS for k in range(BLOCKS + 1)]
        at = self.here[which]
        return np.stack([self.runs(at + a, b - a, 50 + k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], axis=1)


def _key(blocks: np.ndarray) -> np.ndarray:
    """64 bits of the edges; equal windows, equal keys (not the other way round)."""
    return mix(blocks @ np.array([3, 5, 7, 11], np.uint64), 60)


class Work:
    """A row of ``judged_files`` in a task: ids, flags for null ones, numbers
    of words and states by place in the file, and a further list column."""

    def __init__(self, b: pa.RecordBatch, i: int):
        docs = b.column("docs")[i].values
        order = np.argsort(docs.field("idx").to_numpy())
        ids = docs.field("doc_id")
        self.fid, self.file, self._b, self._i = b.column("fid")[i].as_py(), b.column("file")[i].as_py(), b, i
        self.null = np.asarray(ids.is_null())[order]
        self.ids = np.asarray(ids.fill_null(0), np.int64)[order]
        self.n_words, self.state = docs.field("n_words").to_numpy()[order], docs.field("state").to_numpy()[order]

    def list(self, name: str) -> pa.Array | None:
        return self._b.column(name)[self._i].values


def _works(batches: Iterator[pa.RecordBatch]) -> Iterator[Work]:
    for b in batches:
        for i in range(b.num_rows):
            yield Work(b, i)
    release_memory()


# ---------------------------------------------------------------- candidates
def shared_anchors(files: DataFrame, words: int = WORDS) -> DataFrame:
    """(fid, anchors): the file's anchors that several judged rows have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work in _works(batches):
            for c in Words(work.file, words).chunks(work.state == 1):
                anchors = c.anchors()
                change = np.ones(len(anchors), bool)
                change[1:] = (anchors[1:] != anchors[:-1]) | (c.doc[1:] != c.doc[:-1])
                order = np.lexsort((c.doc[change], anchors[change]))
                h, d = anchors[change][order], c.doc[change][order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(np.full(len(new), work.fid)), pa.array(several), pa.array(np.full(len(new), c.at))],
                                                 ["h", "fid", "several", "at"])

    # a file's chunks count as rows of their own: an anchor on both sides of a chunk's end only costs a few needless candidates
    anchors = staged(files.select("fid", "file", "docs").repartition(shuffle_width(files.sparkSession)).mapInArrow(run, "h long, fid long, several boolean, at long"), "anchors")
    where = F.struct("fid", "at")
    shared = anchors.groupBy("h").agg(F.bool_or("several").alias("s"), F.min(where).alias("x"), F.max(where).alias("y")).filter("s OR x != y").select("h")
    return anchors.select("fid", "h").join(shared, "h").groupBy("fid").agg(F.collect_set("h").alias("anchors"))


def candidates(files: DataFrame, anchors: DataFrame, words: int = WORDS) -> DataFrame:
    """The suffixes that may repeat, equal ones of a chunk once: edges, lo (the
    least id), fid, place (document, word, whether other ids have it too)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work in _works(batches):
            ids, wanted, text = work.ids, np.sort(work.list("anchors").to_numpy().view(np.uint64)), Words(work.file, words)
            for c in text.chunks(work.state == 1):
                anchors = c.anchors()
                which = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, anchors), len(wanted) - 1)] == anchors)
                if not len(which):
                    continue
                blocks, doc = c.blocks(which), c.doc[which]
                order = np.lexsort((ids[doc], _key(blocks)))
                blocks, doc, word = blocks[order], doc[order], c.at + c.here[which][order]
                new = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]).any(axis=1)]))
                lo = np.minimum.reduceat(ids[doc], new)
                several = np.maximum.reduceat(ids[doc], new) > lo
                place = (doc[new] << PLACE_BITS) | ((word[new] - text.first[doc[new]]) << 1) | several
                yield pa.RecordBatch.from_arrays([*(pa.array(blocks[new, k].view(np.int64)) for k in range(BLOCKS)), pa.array(lo), pa.array(np.full(len(new), work.fid)), pa.array(place)],
                                                 [*EDGES, "lo", "fid", "place"])

    rows = files.join(anchors, "fid").repartition(shuffle_width(files.sparkSession))
    return staged(rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*EDGES, "lo", "fid", "place"])), "suffixes")


# ---------------------------------------------------------------- trees
def crowded_prefixes(suffixes: DataFrame, group: int) -> list[DataFrame]:
    """For one block, two ..., the prefixes with more than ``group`` suffixes."""
    out, live = [], suffixes
    for k in range(1, BLOCKS + 1):
        crowded = staged(live.groupBy(*EDGES[:k]).count().filter(F.col("count") > group).drop("count"), "crowded")
        if crowded.isEmpty():
            break
        out.append(crowded)
        live = live.join(crowded, EDGES[:k], "left_semi")
    return out


def with_prefix(suffixes: DataFrame, crowded: list[DataFrame]) -> DataFrame:
    """Adds ``prefix``, the number of blocks that deal the suffix to a task:
    the fewest that aren't crowded, one more than there are if all are."""
    depth: Column = F.lit(1)
    for k, some in enumerate(crowded, 1):
        suffixes = suffixes.join(some.withColumn(f"_c{k}", F.lit(1)), EDGES[:k], "left")
        depth = depth + F.when(F.col(f"_c{k}").isNotNull(), 1).otherwise(0)
    return suffixes.select(*EDGES, "lo", "fid", "place", depth.alias("prefix"))


def common_lengths(edges: np.ndarray) -> np.ndarray:
    """How many first edges every sorted suffix shares with the one before it."""
    same = np.zeros(edges.shape, bool)
    same[1:] = edges[1:] == edges[:-1]
    return np.minimum.accumulate(same, axis=1).sum(axis=1)


def internal_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) suffix of the nodes whose suffixes share
    ``depth`` edges or more; single suffixes are leaves, which the caller tells."""
    first = np.flatnonzero(lcp < depth)
    return first, np.append(first[1:], len(lcp))


def deep_repeats(suffixes: DataFrame) -> DataFrame:
    """Rows (fid, place, least): a file's suffixes under a deep node, and the
    least id there, where it is less than an id that the row stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: np.ndarray) -> pa.RecordBatch:
            first, end = internal_nodes(common_lengths(rows[:, :BLOCKS]), BLOCKS)
            least = np.repeat(np.minimum.reduceat(rows[:, BLOCKS], first), end - first)
            hit = (rows[:, BLOCKS] > least) | (rows[:, BLOCKS + 2] & 1 == 1)
            return pa.RecordBatch.from_arrays([pa.array(rows[hit, BLOCKS + 1]), pa.array(rows[hit, BLOCKS + 2]), pa.array(least[hit])], ["fid", "place", "least"])

        held = np.zeros((0, BLOCKS + 3), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in [*EDGES, "lo", "fid", "place"]], axis=1)])
            if len(rows):
                last = internal_nodes(common_lengths(rows[:, :BLOCKS]), BLOCKS)[0][-1]  # its node may go on in the next batch
                if last:
                    yield told(rows[:last])
                held = rows[last:]
        if len(held):
            yield told(held)

    subtree = F.xxhash64("prefix", *(F.when(F.col("prefix") >= k, F.col(c)) for k, c in enumerate(EDGES, 1)))
    trees = suffixes.filter(F.col("prefix") <= BLOCKS).repartition(subtree).sortWithinPartitions(*EDGES)
    return trees.mapInArrow(run, "fid long, place long, least long")


def whole_repeats(suffixes: DataFrame) -> DataFrame:
    """As ``deep_repeats`` for suffixes so frequent that each is a node alone."""
    hot = suffixes.filter(F.col("prefix") > BLOCKS)
    least = staged(hot.groupBy(*EDGES).agg(F.min("lo").alias("least")), "hot-repeats")
    return hot.join(least, EDGES).filter("lo > least OR place % 2 = 1").select("fid", "place", "least")


def repeats(files: DataFrame, words: int = WORDS, group: int = GROUP) -> DataFrame:
    """(fid, marks): for every file the repeats that stand in it, each by one
    of its places and the least id that has it."""
    suffixes = candidates(files, shared_anchors(files, words), words)
    crowded = crowded_prefixes(suffixes, group)
    parted = with_prefix(suffixes, crowded)
    found = deep_repeats(parted)
    if len(crowded) == BLOCKS:
        found = found.unionAll(whole_repeats(parted))
    return found.groupBy("fid").agg(F.collect_list(F.struct("place", "least")).alias("marks"))


# ---------------------------------------------------------------- cut
def _covered(text: Words, ids: np.ndarray, judged: np.ndarray, marks: pa.StructArray) -> np.ndarray:
    """A flag for every word of the file: a repeat of a smaller id covers it."""
    edge = np.zeros(len(text.hashes) + 1, np.int64)
    place, least = marks.field("place").to_numpy(), marks.field("least").to_numpy()
    word = text.first[place >> PLACE_BITS] + ((place & ((1 << PLACE_BITS) - 1)) >> 1)
    blocks = np.zeros((len(word), BLOCKS), np.uint64)
    for c in text.chunks(judged):
        own = np.flatnonzero((word >= c.at) & (word < c.at + STEP))
        blocks[own] = c.blocks(np.searchsorted(c.here, word[own] - c.at))
    order = np.argsort(_key(blocks), kind="stable")
    blocks, least = blocks[order], least[order]
    keys = _key(blocks)
    for c in text.chunks(judged):
        own = c.blocks(np.arange(len(c.here)))
        wanted = _key(own)
        at = np.searchsorted(keys, wanted)
        open_ = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted)
        while len(open_):  # more than once if the same repeat came from several chunks, or keys of unlike windows agree
            same = (blocks[at[open_]] == own[open_]).all(axis=1) & (ids[c.doc[open_]] > least[at[open_]])
            hit = c.at + c.here[open_[same]]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + text.size, -1)
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(keys)]
            open_ = open_[keys[at[open_]] == wanted[open_]]
    return np.cumsum(edge[:-1]) > 0


def cut(files: DataFrame, marks: DataFrame, words: int = WORDS, step: int = 2 << 20) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept (the words left,
    joined by one space), spans (the removed runs of words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work in _works(batches):
            yield from rows(work)

    def rows(work: Work) -> Iterator[pa.RecordBatch]:
        ids, null, n_words, text, marks = work.ids, work.null, work.n_words, Words(work.file, words), work.list("marks")
        gone = np.repeat(work.state == 2, n_words)
        if marks is not None:
            gone |= _covered(text, ids, work.state == 1, marks)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[text.first])
        byte_ends = text.starts[text.first]
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(byte_ends, byte_ends[at] + step, "right")) - 1)
            a, z = text.first[at], text.first[to]
            left = text.data[byte_ends[at]: byte_ends[to]]
            lens = np.diff(text.starts[a: z + 1])
            left = left[np.repeat(~gone[a:z], lens)]
            sizes = np.concatenate([[0], np.cumsum(np.where(gone[a:z], 0, lens))])[text.first[at: to + 1] - a]
            raw = left.tobytes()
            kept = [raw[x: y - 1].decode() if y > x else "" for x, y in zip(sizes, sizes[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at:to], mask=null[at:to]), pa.array(n_words[at:to]), pa.array(n_removed[at:to]), pa.array(kept, pa.string()), _spans(gone[a:z], text.first[at: to + 1] - a)],
                [c.split()[0] for c in OUT.split(", ")])
            at = to

    work = files.join(marks, "fid", "left").repartition(shuffle_width(files.sparkSession))
    return work.mapInArrow(run, OUT)


def _spans(gone: np.ndarray, first: np.ndarray) -> pa.Array:
    """The runs of flagged words of every document, counted from its start."""
    n = np.diff(first)
    edge = np.zeros(len(gone) + 1, bool)
    edge[first] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    start, end = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1
    doc = np.searchsorted(first, start, "right") - 1
    per = np.bincount(doc, minlength=len(n))
    values = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(end - first[doc])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), values)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, group: int = GROUP, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Every document without the passages that stand in documents of smaller ids."""
    folder = scratch_path(docs.sparkSession, "llm", "words")
    files = judged_files(write_files(docs, folder, id_col=id_col, text_col=text_col, words=words, file_bytes=file_bytes), words)
    return cut(files, repeats(files, words, group), words)
