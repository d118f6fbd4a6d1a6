"""Best-fit packing of tokenised documents into sequences of at most `limit` tokens.

Documents over the limit are cut into full pieces and a rest. Packing is bulk-synchronous:

1. Pieces are range-sorted by (length, document, piece) and ranked within their length: local ranks per range partition, plus the
   counts of earlier partitions for that length (a table of partitions + lengths rows at most).
2. The state is a Spark table of runs: of pieces of one length with successive ranks, and of sequences of one gap with successive numbers.
   As lengths are whole numbers up to the limit, it stays that small however large the corpus.
3. A superstep sorts lengths and gaps together, in ranges if there are more than RANGE_ROWS runs, and sweeps each range from large to small: a piece takes its successor, the smallest
   gap before it that is still free; where several want one, the rank decides. What a range leaves over is swept once more together; as
   in the matching of brackets, matches inside a range are those of the whole. Where pieces outnumber all gaps that are left, a gap takes
   several. Then gaps shrink by what was placed. Where open gaps cannot hold the pieces left, the longest of these open as many new
   sequences as their tokens need beyond the gaps; where few found a gap, an eighth of those that the rest would fill.
4. Supersteps repeat until all is placed, some ten to fifty times. Their rows (length, first rank, pieces per sequence, sequences, offset)
   are the plan by which every piece finds its place from its length and rank in parallel.

Defined cases: null and empty texts are one token (the end id); very long texts are tokenised whole in slices at white space; repeated
rows are pieces of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C

LIMIT = 4096
PUNCTUATION = string.punctuation
MARK = "\uf8ff\x00\uf8ff"  # stands after each text as a word of its own; texts that hold it are encoded one by one
SLICE = 1 << 19  # bytes of text tokenised at once
CACHE = 150_000  # white-space words whose ids a task keeps


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def lowered(text: str) -> str:
    """The text as the tokenizer's own lower-casing leaves it, where that is certain, so that fewer different words are met."""
    if "<|" in text or "\u03a3" in text:  # special tokens are told by case; the final sigma depends on its place
        return text
    low = text.lower()
    return low if text.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", low)) else text


class WordIds:
    """ids of texts by white-space words: tokens of this vocabulary never cross white space, so the words' ids in a row are the text's."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # a lean form for words that are lower-cased, composed letters already: the same model without the normaliser
        model = json.loads(self.tok.to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lean = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.at: dict[str, int] = {}
        self.flat, self.start, self.size, self.count = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64, np.int64))
        self.add([MARK], np.ones(1, np.int64), np.ones(1, np.int64))  # the end id

    def keep(self, index: np.ndarray) -> None:
        """Forgets all other words."""
        place = np.full(len(self.start), -1)
        place[index] = np.arange(len(index))
        self.at = {w: p for w, i in self.at.items() if (p := int(place[i])) >= 0}
        size = self.size[index]
        start = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.start[index] - start, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.count = start, size, self.count[index]

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.flat, self.size = np.concatenate((self.flat, ids.astype(np.uint32))), np.concatenate((self.size, size))
        self.count = np.concatenate((self.count, np.zeros(len(words), np.int64)))

    def learn(self, words: list[str]) -> None:
        """Lower-case words, and runs of ASCII punctuation, are one run of tokens each, of which just the last is an end-of-run token; they
        are encoded many at a time. A word with punctuation after it is made of the two. Others go one by one."""
        plain: dict[str, None] = {}
        odd, pairs = [], []
        for w in words:
            base = w.rstrip(PUNCTUATION)
            if base and not (base.isalpha() and base.islower() and (base.isascii() or is_normalized("NFC", base))) or MARK in w or "<|" in w:
                odd.append(w)
            elif base and base is not w:
                pairs.append((w, base, w[len(base) :]))
            else:
                plain[w] = None
        for _, base, tail in pairs:
            for x in (base, tail):
                if x not in self.at:
                    plain[x] = None
        if plain:
            new = list(plain)
            text = ["\n".join(new[i : i + 512]) for i in range(0, len(new), 512)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.lean.encode_batch_fast(text, add_special_tokens=False)])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(new):
                self.add(new, ids, np.diff(ends, prepend=0))
            else:
                odd += new
        if odd:
            found = [e.ids for e in self.tok.encode_batch_fast(odd, add_special_tokens=False)]
            self.add(odd, np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64))
        if pairs:
            parts = np.array([(self.at[b], self.at[t]) for _, b, t in pairs]).ravel()
            size = self.size[parts]
            ids = self.flat[np.repeat(self.start[parts] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            self.add([w for w, _, _ in pairs], ids, size.reshape(-1, 2).sum(1))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets) of texts, each followed by the end id 1."""
        if len(self.at) > CACHE:  # words met once or twice go first
            self.count[self.at[MARK]] += 1 << 40
            often = np.flatnonzero(self.count > 2)
            self.keep(often if len(often) < CACHE * 3 // 4 else often[np.argsort(-self.count[often])[: CACHE // 2]])
        if any(MARK in x for x in texts):
            found = [np.array([*self.tok.encode(x, add_special_tokens=False).ids, 1], np.uint32) for x in texts]
            return np.concatenate(found), np.concatenate(([0], np.cumsum([len(x) for x in found])))
        words = "".join(f"{lowered(x)} {MARK} " for x in texts).split()
        index = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if len(unseen := np.flatnonzero(index < 0)):
            new = [words[i] for i in unseen.tolist()]
            self.learn(list(dict.fromkeys(new)))
            index[unseen] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        self.count += np.bincount(index, minlength=len(self.count))
        size = self.size[index]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[index] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.concatenate(([0], total[1:][index == self.at[MARK]]))


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker: its words serve later tasks, and its memory is not taken anew for each."""
    if path not in _made:
        _made[path] = WordIds(path)
        C.trim()
    return _made[path]


def tokenise(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(path)
        for b in batches:
            ids = b.column(0)
            at, n = 0, b.num_rows
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy()
            while at < n:
                end = at + 1
                size = int(lengths[at])
                while end < n and size + lengths[end] <= SLICE:
                    size += int(lengths[end])
                    end += 1
                flat, offs = tok.batch([x or "" for x in b.column(1).slice(at, end - at).to_pylist()])
                doc, piece, start, length, crc, blobs = [], [], [], [], [], []
                for i in range(end - at):
                    a, z = int(offs[i]), int(offs[i + 1])
                    for k, s in enumerate(range(a, z, limit)):
                        e = min(s + limit, z)
                        blob = flat[s:e].tobytes()
                        doc.append(i)
                        piece.append(k)
                        start.append(s - a)
                        length.append(e - s)
                        crc.append(zlib.crc32(blob))
                        if with_ids:
                            blobs.append(blob)
                cols = [ids.slice(at, end - at).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(blobs, pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
                at = end
                C.trim()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with `part`, their range partition, and `local`, their rank among that partition's pieces of the same length."""
    parts = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, last, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            n = b.column("length").to_numpy()
            if not len(n):
                continue
            first = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
            run_no = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(n)]))))
            local = np.arange(len(n)) - first[run_no]
            if n[0] == last:
                local[run_no == 0] += seen
            last, seen = int(n[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), me), pa.int32()), pa.array(local, pa.int64())], names=[*b.schema.names, "part", "local"])

    kinds = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return parts.mapInArrow(run, f"{kinds}, part int, local long")


GAP, PIECES, PLACED, NEXT = range(4)  # kinds of rows; NEXT: the number that the next new sequence gets, how many have a gap, and the runs
STATE = "kind int, size long, first long, n long, per long, gap long, seq long"
#: A superstep that places less than a tenth of what is left opens an eighth of the sequences that the rest would fill.
SLOW, STEP = 10, 8
RANGE_ROWS = 20_000  # runs that one task sweeps


def matched(rows: list[tuple[int, ...]], supply: int) -> tuple[list[tuple[int, ...]], list[list[int]], list[list[int]]]:
    """(placed, pieces left, gaps left) of a sweep from large to small; rows: (kind, size, first, n), gaps before pieces of their size; supply:
    the number of gaps in all ranges."""
    placed, left, free = [], [], []
    for kind, size, first, n in rows:
        if kind == GAP:
            free.append([size, first, n])
            continue
        while n and free:
            gap, seq, m = free[-1]
            per = max(1, min(gap // size, n // supply))
            t = min(n // per, m)
            placed.append((size, first, t, per, gap, seq))
            first, n = first + t * per, n - t * per
            if t == m:
                free.pop()
            else:
                free[-1] = [gap, seq + t, m - t]
        if n:
            left.append([size, first, n])
    return placed, left, free


def state_rows(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    names = [x.split()[0] for x in STATE.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(cols)], names=names)


def taken(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, ...]]:
    return [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True)]


def swept(supply: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sweep of one range."""
        rows = taken(batches)
        placed, left, free = matched([r[:4] for r in rows if r[0] != NEXT], supply)
        out = [(PLACED, *p) for p in placed] + [(PIECES, *x, 0, 0, 0) for x in left] + [(GAP, *x, 0, 0, 0) for x in free]
        yield state_rows(out + [r for r in rows if r[0] == NEXT])

    return run


def settled(limit: int, supply: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sweep of what the ranges left, new sequences, and the shrunken gaps. In order of size."""
        rows = taken(batches)
        more, left, free = matched([r[:4] for r in rows if r[0] in (GAP, PIECES)], supply)
        placed = [r[1:] for r in rows if r[0] == PLACED] + more
        fresh = sum(r[2] for r in rows if r[0] == NEXT)
        gaps = [*free, *([gap - per * size, seq, n] for size, _, n, per, gap, seq in placed if gap > per * size)]
        need, room = sum(x[0] * x[2] for x in left), sum(x[0] * x[2] for x in gaps)
        found, open_ = sum(p[2] * p[3] for p in placed), sum(x[2] for x in left)
        new = -(-(need - room) // limit) if need > room else 0 if found * SLOW >= open_ else max(1, -(-need // limit) // STEP)
        for x in left:  # longest first
            t = min(new, x[2])
            if t:
                placed.append((x[0], x[1], t, 1, limit, fresh))
                if limit > x[0]:
                    gaps.append([limit - x[0], fresh, t])
                new, fresh = new - t, fresh + t
                x[1], x[2] = x[1] + t, x[2] - t
        out = [(PLACED, *p) for p in placed] + [(PIECES, *x, 0, 0, 0) for x in left if x[2]] + [(GAP, *x, 0, 0, 0) for x in gaps]
        yield state_rows([*out, (NEXT, 0, fresh, sum(x[2] for x in gaps), len(gaps) + sum(x[2] > 0 for x in left), 0, 0)])

    return run


def plan(counts: dict[int, int], spark, limit: int = LIMIT) -> list[tuple[int, ...]]:
    """Rows (length, first rank, sequences, pieces per sequence, gap, first sequence) that place counts[length] pieces of each length."""
    state = spark.createDataFrame([(PIECES, k, 0, n, 0, 0, 0) for k, n in counts.items()] + [(NEXT, 0, 0, 0, 0, 0, 0)], STATE)
    order = [F.col("size").desc(), "kind", "first"]
    rows: list[tuple[int, ...]] = []
    supply, runs = 0, len(counts)
    while True:
        if runs > RANGE_ROWS:
            cut = state.repartitionByRange(F.col("size").desc()).sortWithinPartitions(*order).mapInArrow(swept(supply), STATE)
        else:
            cut = state
        step = C.stage(cut.coalesce(1).sortWithinPartitions(*order).mapInArrow(settled(limit, supply), STATE), "pack-step")
        C.unstage(state)
        # what a superstep placed, by lengths and gaps, and the number of gaps
        got = step.where(F.col("kind").isin(PLACED, NEXT)).select("kind", "size", "first", "n", "per", "gap", "seq").collect()
        rows += [tuple(r)[1:] for r in got if r[0] == PLACED]
        supply, runs = (sum(r[k] for r in got if r[0] == NEXT) for k in (3, 4))
        if sum(r[2] * r[3] for r in rows) == sum(counts.values()):
            C.unstage(step)
            return sorted(rows)
        state = step.where(F.col("kind") != PLACED)
        state._staged = step._staged


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of each piece."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    # tokenised once and kept as a table: range-sorting samples its input, which must not tokenise again
    pieces = C.stage(tokenise(docs, path, limit, with_ids), "pack-pieces")
    table = C.stage(ranked(pieces), "pack-ranked")
    C.unstage(pieces)
    here = table.groupBy("length", "part").agg(F.count("*").alias("n")).collect()  # range partitions + lengths rows
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for length, part, n in sorted((r[0], r[1], r[2]) for r in here):
        before[length, part] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    rows = plan(counts, spark, limit) if counts else []
    arrays = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
    keys = sorted(before)
    base = (np.array([a * (1 << 32) + p for a, p in keys], np.int64), np.array([before[k] for k in keys], np.int64))
    shared = spark.sparkContext.broadcast((arrays, base))  # bounded by lengths and range partitions, not by the corpus

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not b.num_rows:
            return None
        (length, rank, _, per, gap, first), (keys, counts) = shared.value
        n, part, local = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "part", "local"))
        r = local + counts[np.searchsorted(keys, n * (1 << 32) + part)]
        # rows are sorted by (length, rank): the last row at or before
        big = np.int64(1) << np.int64(48)
        k = np.searchsorted(length * big + rank, n * big + r, "right") - 1
        q = r - rank[k]
        names = [c for c in b.schema.names if c not in ("part", "local", "ids")]
        cols = [b.column(c) for c in names] + [pa.array(first[k] + q // per[k]), pa.array(limit - gap[k] + (q % per[k]) * n)]
        more = ["ids"] if with_ids else []
        return pa.RecordBatch.from_arrays(cols + [b.column(c) for c in more], names=[*names, "sequence_id", "offset", *more])

    return table.mapInArrow(C.by_batch(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the token ids of each sequence, from pack(..., with_ids=True). A sequence has at most `limit` pieces."""
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))
