"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning, per shard, merged exactly with global statistics.

Each task indexes its part of the corpus as shards of at most ``SHARD_POSTINGS`` postings, files in the shared folder; no text is
shuffled. A shard orders its documents so that like ones stand together (by their most frequent word, then length), in blocks
of ``BLOCK`` documents. Every word has its largest impact in the shard. A word that many documents of a block hold has a long list there, with
its largest impact in the block; its other postings are its short list. (Beyond ``LONG_CELLS`` the thinnest long lists are read as short ones.)

A task has a block of queries (``QUERY_WORDS`` words at most) and takes shard after shard, so each query goes through the shards with the k-th best score
of those before as its floor. Queries go through a shard in batches of like ones, so that a block's lists are read once for all queries that open it:

* pivot: a query's words in order of their largest impact; where all together stay below the floor, no word is left from the pivot on and the shard is left out;
* block test: a block is skipped by each query for which what its short lists give plus the block maxima of its long lists stays below
  the floor (so do blocks with none of the words from the pivot on). The maxima of all queries and blocks are one product of matrices;
* document test: for a block and the queries that open it, the long lists' impacts, written out, are products, those most documents hold first. After
  each step a document stays if what it has, plus what the lists to come can give, may reach the floor: they give no more than the query asks of them at most, and
  no more than the document has for all of them. Short documents so end after a step or two. The sums bound scores from both sides, so they
  raise the floor before any document is scored, and only documents that may stay among the k best are scored whole.

A query without k documents yet first scores those to which its short lists give most, to have a floor.

Document frequencies, number and mean length are those of the whole corpus, so scores of shards compare; a query carries its k best from
shard to shard, which is the exact merge. Nothing that grows is broadcast or comes to the driver.

score = sum over the query's distinct words of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), idf =
ln(1 + (N - df + 0.5) / (df + 0.5)), rounded to 6 places; equal scores go by id. Words: as for decontamination; they are
told apart by their 64-bit hash (two of a billion distinct words agree with probability 0.03).

Edge cases: null and empty texts have no word, are found by no query and find nothing; repeated rows are separate documents;
ties in score go to the smaller ``doc_id``, null ids last; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_path, text_bytes
from .decontaminate import words_of
from .encoding import filesystem

K1, B = 1.2, 0.75
TOP = 10
#: Documents of a block; postings and documents of a shard at most, but for one that is larger by itself.
BLOCK, SHARD_POSTINGS, SHARD_DOCS = 256, 4_000_000, 1 << 16
#: A word's list is long in a block if its documents there, times the share of the shard's that hold it, are this many at least. Long lists of a block's first step; the
#: second has twice as many, and so on.
LONG_SHARE, STEP = 0.8, 96
#: Postings of short lists that are read at once, but for a query that has more by itself.
READ_POSTINGS = 1 << 18
#: Cells of a shard's written-out lists, and of what a batch of queries is given, at most (4 bytes each).
LONG_CELLS, BATCH_CELLS = 1 << 24, 1 << 23
#: Bounds exceed scores by this share at most; what lists to come can give is raised by this share, more than sums in 32 bits may lack.
LOOSE, SAFE = 0.02, 1e-3
#: Documents of a query that are scored at once.
SCORED = 64
#: Words of queries that a task holds at once, about.
QUERY_WORDS = 4_000_000
DECIMALS = 6

#: Arrays of a shard file, in their order.
PARTS = ("ids", "no_id", "asks", "lengths", "words", "df", "place", "tf", "starts", "rows", "row_tf")


def _counted(data: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a text's distinct words in ascending order, their counts, and the number of its words."""
    from xxhash import xxh64_intdigest

    words = words_of(data)
    tf = Counter(words)
    keys = np.fromiter(map(xxh64_intdigest, tf), np.uint64, len(tf))
    order = np.argsort(keys)
    return keys[order], np.fromiter(tf.values(), np.uint32, len(tf))[order], len(words)


def shard_parts(ids: list[int | None], asks: list[bool], counted: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[str, np.ndarray]:
    """The arrays of a shard: documents in their order of places, postings by word and place, and each document's words (rows of ``words``)."""
    lead = np.array([k[int(np.argmax(c))] if len(k) else 0 for k, c, _ in counted], np.uint64)
    lengths = np.array([n for _, _, n in counted], np.int64)
    at = np.lexsort((lengths, lead))
    sizes = np.array([len(counted[i][0]) for i in at], np.int64)
    terms, tf = (np.concatenate([counted[i][k] for i in at]) if len(at) else np.array([], t) for k, t in ((0, np.uint64), (1, np.uint32)))
    words, rows, df = np.unique(terms, return_inverse=True, return_counts=True)
    by_word = np.argsort(rows, kind="stable")
    place = np.repeat(np.arange(len(at)), sizes)
    own = [ids[i] for i in at]
    return {
        "ids": np.array([0 if x is None else x for x in own], np.int64), "no_id": np.array([x is None for x in own], bool), "asks": np.array([asks[i] for i in at], bool), "lengths": lengths[at],
        "words": words, "df": df.astype(np.int32), "place": place[by_word].astype(np.int32), "tf": tf[by_word], "starts": np.concatenate(([0], np.cumsum(sizes))), "rows": rows.astype(np.int32), "row_tf": tf,
    }


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges one after another, and the range each belongs to."""
    size = stop - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + (start - np.cumsum(size) + size)[owner], owner


class Shard:
    def __init__(self, parts: dict[str, np.ndarray], mean: float):
        self.ids, self.no_id, self.words, self.starts, self.rows, self.row_tf = (parts[k] for k in ("ids", "no_id", "words", "starts", "rows", "row_tf"))
        n = self.n = len(self.ids)
        self.n_blocks = -(-n // BLOCK)
        #: tf / (tf + norm) times k1 + 1 is the impact.
        self.norm = K1 * (1 - B + B * parts["lengths"] / max(mean, 1e-9))
        df, place, tf = parts["df"], parts["place"], parts["tf"]
        # Bounds are in 32 bits, a little above the impact.
        impact = tf.astype(np.float32)
        impact *= np.float32((K1 + 1) * (1 + 2.0**-20)) / (impact + self.norm.astype(np.float32)[place])
        last = np.cumsum(df, dtype=np.int64)
        self.most = np.maximum.reduceat(impact, last - df) if len(df) else np.array([], np.float32)
        word, block = np.repeat(np.arange(len(df), dtype=np.int32), df), place // BLOCK
        # Runs: a word's postings in a block.
        begins = np.ones(len(place), bool)
        begins[1:] = (block[1:] != block[:-1]) | (word[1:] != word[:-1])
        run = np.flatnonzero(begins)
        size = np.diff(run, append=len(place))
        long = np.flatnonzero(size * df[word[run]].astype(np.int64) >= LONG_SHARE * n)
        if len(long) > LONG_CELLS // BLOCK:
            long = np.sort(long[np.argsort(-size[long], kind="stable")[: LONG_CELLS // BLOCK]])
        # By block, those that most of its documents hold first.
        long = long[np.lexsort((-size[long], block[run[long]]))]
        its_word, its_block = word[run[long]], block[run[long]]
        wide, self.columns = np.unique(its_word, return_inverse=True)
        #: A block's long lists are those from one cut to the next.
        self.cuts = np.searchsorted(its_block, np.arange(self.n_blocks + 1))
        #: Lists: a word's short one has the word's row, the long ones follow. Their row in the tables of blocks, -1 for short ones.
        self.long = np.concatenate((np.full(len(df), -1), np.arange(len(wide))))
        #: A word's long list, -1 if it has none.
        self.wide = np.full(len(df), -1)
        self.wide[wide] = len(df) + np.arange(len(wide))
        #: Impacts of the long lists, written out by block, word and document; their largest, also by word and block.
        posts, owner = _ranges(run[long], run[long] + size[long])
        self.out = np.zeros((len(long), BLOCK), np.float32)
        self.out.ravel()[owner * BLOCK + place[posts] % BLOCK] = impact[posts]
        self.out_most = self.out.max(axis=1)
        self.block_most = np.zeros((len(wide), self.n_blocks), np.float32)
        self.block_most[self.columns, its_block] = self.out_most
        short = np.ones(len(place), bool)
        short[posts] = False
        self.short = place[short], impact[short], word[short]
        #: First posting and size of each word's short list.
        self.size = df - np.bincount(its_word, size[long], len(df)).astype(np.int32)
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)
        #: The words' weights, and which are a query's own while its documents are scored.
        self.weight, self.marked = np.zeros(len(df)), np.zeros(len(df), bool)

    def rows_of(self, terms: np.ndarray) -> np.ndarray:
        """Row of each of some ascending hashes, -1 for those that the shard doesn't hold."""
        if not len(self.words):
            return np.full(len(terms), -1)
        k = np.searchsorted(self.words, terms)
        k[k == len(self.words)] = 0
        return np.where(self.words[k] == terms, k, -1)

    def _weigh(self, asked: list[tuple[np.ndarray, np.ndarray, "Best"]]) -> None:
        """Takes the words' weights, which are alike for all queries, into the lists."""
        for rows, weights, _ in asked:
            self.weight[rows] = weights
        places, impact, word = self.short
        # What each posting of the short lists gives, no less and up to LOOSE more, as its last 16 bits are its place.
        self.posts = (impact * (self.weight * (1 + 2.0**-7 + 2.0**-12)).astype(np.float32)[word]).view(np.int32)
        self.posts &= -SHARD_DOCS
        self.posts |= places
        of_column = np.zeros(len(self.block_most), np.float32)
        has = np.flatnonzero(self.wide >= 0)
        of_column[self.long[self.wide[has]]] = self.weight[has] * (1 + SAFE)
        #: For each block its long lists' steps, and what a step and those after it can give to each document at most.
        self.steps = []
        for first, last in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            ends = [first]
            while ends[-1] < last:
                end = ends[-1] + STEP * len(ends)
                ends.append(last if last - end < STEP else end)
            mass = [of_column[self.columns[a:b]] @ self.out[a:b] for a, b in zip(ends, ends[1:])]
            self.steps.append([(a, b, m) for a, b, m in zip(ends, ends[1:], np.cumsum(mass[::-1], axis=0)[::-1])])

    def _given(self, rows: np.ndarray, out: list[tuple[int, np.ndarray]]) -> None:
        """Writes what short lists give to each document for some queries one after another, of so many rows each."""
        size = self.size[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.first[rows] - ends + size, size)
        at += np.arange(len(at))
        posts = self.posts[at]
        ends = ends[np.cumsum([n for n, _ in out]) - 1]
        places, gives, first = posts & (SHARD_DOCS - 1), posts.view(np.float32), 0
        for (_, to), last in zip(out, ends.tolist()):
            to[: self.n] = np.bincount(places[first:last], gives[first:last], self.n)
            first = last

    def scores(self, places: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of some documents; words are added in the order of their hashes, so equal documents score alike everywhere."""
        first = self.starts[places]
        size = self.starts[places + 1] - first
        ends = np.cumsum(size)
        own = np.concatenate([self.rows[a : a + n] for a, n in zip(first.tolist(), size.tolist())])
        if len(own) < 4 * len(rows):
            at = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
            both = np.flatnonzero(rows[at] == own)
            its = weights[at[both]]
        else:
            self.weight[rows], self.marked[rows] = weights, True
            both = np.flatnonzero(self.marked[own])
            self.marked[rows] = False
            its = self.weight[own[both]]
        owner = np.searchsorted(ends, both, side="right")
        tf = self.row_tf[both + (first - ends + size)[owner]]
        total = np.bincount(owner, its * (tf * (K1 + 1) / (tf + self.norm[places[owner]])), len(places))
        return np.array([round(x, DECIMALS) for x in total.tolist()])

    def _take(self, best: "Best", places: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
        best.take(self.scores(places, rows, weights), self.ids[places], self.no_id[places])

    def search(self, asked: list[tuple[np.ndarray, np.ndarray, "Best"]]) -> None:
        """Takes the shard's documents that belong there into each query's best; a query's rows ascend, and a word's weight is the same in all of them."""
        # Where no word is left from the pivot on, the shard has nothing for the query.
        asked = [q for q in asked if len(q[0])]
        if not asked:
            return
        sizes = np.array([len(rows) for rows, _, _ in asked])
        most = np.add.reduceat(np.concatenate([w for _, w, _ in asked]) * self.most[np.concatenate([rows for rows, _, _ in asked])], np.cumsum(sizes) - sizes)
        asked = [q for q, m in zip(asked, most.tolist()) if m >= q[2].least]
        self._weigh(asked)
        batches = -(-len(asked) // max(1, BATCH_CELLS // max(self.n_blocks * BLOCK, len(self.block_most))))
        for k in range(batches):
            self._search(asked[k * len(asked) // batches : (k + 1) * len(asked) // batches])

    def _search(self, asked: list[tuple[np.ndarray, np.ndarray, "Best"]]) -> None:
        given = np.zeros((len(asked), self.n_blocks * BLOCK), np.float32)
        ahead = np.zeros((len(self.block_most), len(asked)), np.float32)
        sizes = [len(rows) for rows, _, _ in asked]
        rows = np.concatenate([rows for rows, _, _ in asked])
        lists = self.wide[rows]
        has = np.flatnonzero(lists >= 0)
        ahead[self.long[lists[has]], np.repeat(np.arange(len(asked)), sizes)[has]] = np.concatenate([weights for _, weights, _ in asked])[has]
        cuts = np.cumsum([0, *sizes])
        posts = np.concatenate(([0], np.cumsum(self.size[rows], dtype=np.int64)))[cuts]
        k = 0
        while k < len(asked):
            end = max(k + 1, int(np.searchsorted(posts, posts[k] + READ_POSTINGS, side="right")) - 1)
            self._given(rows[cuts[k] : cuts[end]], [(sizes[i], given[i]) for i in range(k, end)])
            k = end
        for k, (rows, weights, best) in enumerate(asked):
            if len(best.score) < best.top:
                # A floor to begin with: the documents to which short lists give most.
                places = np.argpartition(-given[k, : self.n], min(best.top, self.n) - 1)[: best.top]
                self._take(best, places, rows, weights)
                given[k, places] = -np.inf
        least = np.array([best.least for _, _, best in asked], np.float32)
        most = ahead.T @ self.block_most
        left = most + given.reshape(len(asked), self.n_blocks, BLOCK).max(axis=2) >= least[:, None]
        found = [(np.array([], np.int32), np.array([], np.int32), np.array([], np.float32))]
        for block in np.flatnonzero(left.any(axis=0)).tolist():
            who, within, bounds = self._opened(block, np.flatnonzero(left[:, block]), ahead, most[:, block], given, least)
            if len(who):
                found.append((who.astype(np.int32), (block * BLOCK + within).astype(np.int32), bounds))
        who, places, bounds = (np.concatenate(x) for x in zip(*found))
        # Those of the largest bounds first, as they raise the floor.
        order = np.lexsort((-bounds, who))
        who, places, bounds = who[order], places[order], bounds[order]
        cuts = np.flatnonzero(np.diff(who)) + 1
        for k, mine, theirs in zip(who[np.concatenate(([0], cuts))].tolist() if len(who) else [], np.split(places, cuts), np.split(bounds, cuts)):
            rows, weights, best = asked[k]
            good = theirs >= best.least_with(theirs[: best.top])
            mine, theirs = mine[good], theirs[good]
            for first in range(0, len(mine), SCORED):
                some = slice(first, first + SCORED)
                ready = mine[some][theirs[some] >= best.least]
                if not len(ready):
                    break
                self._take(best, ready, rows, weights)

    def _opened(self, block: int, who: np.ndarray, ahead: np.ndarray, most: np.ndarray, given: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the queries that open a block and its documents, the pairs that may reach the floor, and their bounds."""
        bounds = given[who, block * BLOCK : (block + 1) * BLOCK]
        floor, rest = least[who, None], most[who, None] * np.float32(1 + SAFE)
        for first, last, mass in self.steps[block]:
            # What this step and the next can give: no more than the query asks of them, nor than the document has for all words.
            can = np.minimum(rest, mass)
            can += bounds
            alive = np.flatnonzero((can >= floor).any(axis=1))
            if len(alive) < 0.8 * len(who):
                who, bounds, floor, rest = who[alive], bounds[alive], floor[alive], rest[alive]
            if not len(alive):
                break
            mine = ahead[self.columns[first:last]]
            if len(who) < len(least):
                mine = mine[:, who]
            bounds += mine.T @ self.out[first:last]
            rest -= (self.out_most[first:last] @ mine)[:, None]
        at, within = np.nonzero((bounds >= floor) & (bounds > 0))
        return who[at], within, bounds[at, within]


@dataclass
class Best:
    """The best ``top`` documents of a query so far, and the least bound that may still change them."""

    top: int
    score: np.ndarray = field(default_factory=lambda: np.array([]))
    id: np.ndarray = field(default_factory=lambda: np.array([], np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.array([], bool))
    least: float = 0.0
    floor: float = 0.0
    #: Bounds are sums in 32 bits: by this share they may fall short.
    slack: float = 1e-4

    def take(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = (score > 0) & (score >= self.floor)
        if not good.any():
            return
        score, ids, no_id = (np.concatenate(x) for x in ((self.score, score[good]), (self.id, ids[good]), (self.no_id, no_id[good])))
        order = np.lexsort((ids, no_id, -score))[: self.top]
        self.score, self.id, self.no_id = score[order], ids[order], no_id[order]
        if len(order) == self.top:
            self.floor = float(self.score[-1])
            self.least = self._below(self.floor)

    def _below(self, score: float) -> float:
        return max(0.0, score * (1 - self.slack) - 2 * 10.0**-DECIMALS)

    def least_with(self, bounds: np.ndarray) -> float:
        """The least bound that counts beside documents of these bounds, the largest of others than those at hand."""
        if len(self.score) + len(bounds) < self.top:
            return self.least
        low = np.concatenate((self.score, bounds * (1 - self.slack - LOOSE) - 2 * 10.0**-DECIMALS))
        return max(self.least, self._below(float(np.partition(low, -self.top)[-self.top])))


def _write_shard(folder: str, name: str, parts: dict[str, np.ndarray]) -> None:
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        for k in PARTS:
            np.lib.format.write_array(out, np.ascontiguousarray(parts[k]), allow_pickle=False)


def _read_shard(folder: str, name: str, wanted: tuple[str, ...] = PARTS) -> dict[str, np.ndarray]:
    """The first arrays up to the last wanted one."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as file:
        return {k: np.lib.format.read_array(file, allow_pickle=False) for k in PARTS[: max(map(PARTS.index, wanted)) + 1]}


def _indexer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, asks, counted, postings = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"shard-{part:07d}-{uuid.uuid4().hex}.npy"
            _write_shard(folder, name, shard_parts(ids, asks, counted))
            row = {"shard": part * (1 << 20) + made, "file": name, "n_docs": len(ids), "n_words": sum(n for _, _, n in counted), "asked_words": sum(len(k) for (k, _, _), a in zip(counted, asks) if a)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("file", pa.string()), *((k, pa.int64()) for k in ("n_docs", "n_words", "asked_words"))]))

        for batch in batches:
            for doc_id, ask, data in zip(batch.column("doc_id").to_pylist(), batch.column("asks").to_pylist(), text_bytes(batch.column("text"))):
                one = _counted(data)
                if ids and (postings + len(one[0]) > SHARD_POSTINGS or len(ids) == SHARD_DOCS):
                    yield flush()
                    ids, asks, counted, postings, made = [], [], [], 0, made + 1
                ids.append(doc_id)
                asks.append(ask)
                counted.append(one)
                postings += len(one[0])
        if ids:
            yield flush()

    return run


def _frequencies(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                parts = _read_shard(folder, name, ("words", "df"))
                for k in range(0, len(parts["words"]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(parts["words"][k : k + (1 << 18)].view(np.int64)), pa.array(parts["df"][k : k + (1 << 18)].astype(np.int64))], names=["term", "n"])

    return run


def _asked(folder: str):
    """(row, query_id, term) of the documents that ask; ``row`` is the document itself, by shard and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist()):
                p = _read_shard(folder, name)
                places = np.flatnonzero(p["asks"])
                for k in range(0, len(places), 256):
                    some = places[k : k + 256]
                    posts, owner = _ranges(p["starts"][some], p["starts"][some + 1])
                    ids = pa.array(p["ids"][some], mask=p["no_id"][some])
                    yield pa.RecordBatch.from_arrays([pa.array(shard * SHARD_DOCS + some[owner]), ids.take(pa.array(owner)), pa.array(p["words"][p["rows"][posts]].view(np.int64))], names=["row", "query_id", "term"])

    return run


def _searcher(folder: str, manifest: str, n_docs: int, mean: float, top: int):
    def answers(queries: list[tuple[int | None, np.ndarray, np.ndarray]], first: int) -> pa.RecordBatch:
        import pyarrow.dataset as ds

        # Like ones together, as they open the same blocks: those with the same commonest word, and then of a size.
        queries = sorted(queries, key=lambda q: (int(q[1][np.argmax(q[2])]), len(q[1])))
        fs, path = filesystem(manifest)
        files = sorted(ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["file"]).column("file").to_pylist())
        terms, place = np.unique(np.concatenate([w for _, w, _ in queries]), return_inverse=True)
        df = np.empty(len(terms))
        df[place] = np.concatenate([d for _, _, d in queries])
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        ends = np.cumsum([len(w) for _, w, _ in queries])[:-1]
        # The words of all queries one after another, those of each in ascending order.
        flat = np.concatenate([np.sort(w) for w in np.split(place, ends)])
        weights = idf[flat]
        best = [Best(top, slack=max(1e-4, len(w) * 2.0**-22)) for _, w, _ in queries]
        # Tasks begin at different shards, so that not all read the same file at once.
        for k in range(len(files)):
            shard = Shard(_read_shard(folder, files[(first + k) % len(files)]), mean)
            rows = shard.rows_of(terms)
            there = rows[flat]
            held = np.flatnonzero(there >= 0)
            cuts = np.searchsorted(held, ends)
            shard.search(list(zip(np.split(there[held], cuts), np.split(weights[held], cuts), best)))
        n = [len(b.score) for b in best]
        whose = np.repeat(np.arange(len(best)), n)
        asked = pa.array([q for q, _, _ in queries], pa.int64()).take(pa.array(whose))
        ids = pa.array(np.concatenate([b.id for b in best]), mask=np.concatenate([b.no_id for b in best]))
        rank = np.concatenate([np.arange(1, x + 1) for x in n]).astype(np.int32)
        return pa.RecordBatch.from_arrays([asked, pa.array(rank), ids, pa.array(np.concatenate([b.score for b in best]))], names=["query_id", "rank", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, first = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for query_id, words, df in zip(batch.column("query_id").to_pylist(), batch.column("words"), batch.column("df")):
                held.append((query_id, words.values.to_numpy().view(np.uint64), df.values.to_numpy()))
                size += len(held[-1][1])
                if size > QUERY_WORDS:
                    yield answers(held, first)
                    held, size = [], 0
        if held:
            yield answers(held, first)

    return run


def top_k(docs: DataFrame, queries: Column, doc_id: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): the best ``top`` of all rows for each row that satisfies ``queries``."""
    spark = docs.sparkSession
    folder, manifest, listed = new_path(spark, "shards"), new_path(spark, "shard-list"), "shard bigint, file string, n_docs bigint, n_words bigint, asked_words bigint"
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(queries, F.lit(False)).alias("asks"))
    map_arrow(slim, _indexer(folder), listed).write.parquet(manifest)
    made = spark.read.schema(listed).parquet(manifest)
    n = made.agg(F.count("*").alias("shards"), F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words"), F.sum("asked_words").alias("asked")).first()
    shards = made.select("shard", "file").repartition(max(1, n.shards))
    df = map_arrow(shards, _frequencies(folder), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    asked = map_arrow(shards, _asked(folder), "row bigint, query_id bigint, term bigint")
    # Both sides grow with the input: merged at every size, never broadcast.
    each = asked.hint("merge").join(df, "term").groupBy("row").agg(F.first("query_id").alias("query_id"), F.collect_list(F.struct("term", "df")).alias("t"))
    # As many blocks of queries as hold QUERY_WORDS words each, and enough for every core to have some; each of them opens all shards.
    blocks = max(1, -(-(n.asked or 0) // QUERY_WORDS), spark.sparkContext.defaultParallelism)
    ready = materialize(each.select("row", "query_id", F.col("t.term").alias("words"), F.col("t.df").alias("df")), "queries").repartition(blocks)
    mean = (n.words or 0) / max(1, n.docs or 0)
    return map_arrow(ready.select("query_id", "words", "df"), _searcher(folder, manifest, n.docs or 0, mean, top), "query_id bigint, rank int, doc_id bigint, score double")



ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
len AS (SELECT doc_id, len(w)::DOUBLE AS dl FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM len),
idf AS (SELECT t, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t), s),
hit AS (
  SELECT q.doc_id AS query_id, x.doc_id, round(sum(idf * x.tf * 2.2 / (x.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM tf q JOIN tf x USING (t) JOIN idf USING (t) JOIN len ON len.doc_id = x.doc_id, s
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, x.doc_id)
SELECT query_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit) WHERE rank <= 10
"""
