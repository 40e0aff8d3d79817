"""Line dedup: texts that share rare line hashes are aligned by patience diff; aligned common blocks go from the later text.

A line alone may be short or common, so a line's hash is taken together with its neighbours until the run has
`least_words` words, once with the lines that follow and once with those before. A run is as rare as the rarest of its
lines. Runs that at most RARE_TEXTS texts have are joined as they are, as no key of that join can be hot; what more texts
have goes through a salted join, so no run is left out. Every line of a common block of that many words lies in a run, of
either direction, that is inside the block: so if each text is aligned with the first owner of each of its runs, a text
meets every earlier text that it needs to, though a run and a text give one pair at most and never all pairs of a group
arise. What goes follows from the alignments alone, and a line that goes is in an earlier text, so the first text with a
line keeps it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, by_text, map_slices, materialize, release, salted_join, small_batches, text_bytes, word_spans

LEAST_WORDS, RARE_TEXTS, SALTS = 50, 64, 64
#: Alignments of a pair go from lines that the earlier text has once to lines that it has so many times.
COPIES = (1, 2, 4, 8, 16)
_HASHER: list[ByteHasher] = []


def _hasher() -> ByteHasher:
    if not _HASHER:
        _HASHER.append(ByteHasher(61))
    return _HASHER[0]


def lines_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, words, line numbers) of the lines of each text that have words; a line is hashed from its first to its last word."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts, stops = word_spans(data)
    line = np.searchsorted(ends, starts)
    used, first, words = np.unique(line, return_index=True, return_counts=True)
    h = _hasher().spans(_hasher().sums(data), starts[first], stops[first + words - 1])
    last_line = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)
    out, before = [], 0
    cuts = np.searchsorted(used, last_line, side="right")
    for k, cut in enumerate(cuts.tolist()):
        base = 0 if k == 0 else int(last_line[k - 1]) + 1
        out.append((h[before:cut].view(np.int64), words[before:cut].astype(np.int32), (used[before:cut] - base).astype(np.int32)))
        before = cut
    return out


def runs(h: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of the shortest run of lines of at least `least` words from each line on, then of the shortest that ends with each line."""
    total = np.concatenate(([0], np.cumsum(words)))
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.flatnonzero(stop <= len(h))
    stop = stop[start]
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    ends = np.flatnonzero(total[1:] >= least)
    start, stop = np.concatenate([start, back[ends]]), np.concatenate([stop, ends + 1])
    if not len(start):
        return np.zeros(0, dtype=np.int64), start, stop
    data = np.ascontiguousarray(h).view(np.uint8)
    return _hasher().spans(_hasher().sums(data), start * 8, stop * 8).view(np.int64), start, stop


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by their first, whose seconds increase: patience sorting."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[pile], ends[pile] = j, n
        back[n] = ends[pile - 1] if pile else -1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _chains(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Pairs, sorted by their first, as alignments: a longest one, then what it leaves, each pair behind the nearest that it can follow."""
    best = _increasing(pairs)
    out, used = [best] if best else [], set(best)
    tails: list[int] = []
    open_: list[list[tuple[int, int]]] = []
    for i, j in pairs:
        if (i, j) in used:
            continue
        at = bisect_left(tails, j) - 1
        if at < 0:
            tails.insert(0, j)
            open_.insert(0, [(i, j)])
            out.append(open_[0])
        else:
            tails[at] = j
            open_[at].append((i, j))
    return out


def shared_blocks(a: np.ndarray, b: np.ndarray, words: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """[start, stop) of the blocks of b's lines, of at least `least` words each, that alignments with a find; neighbouring ones are joined.

    First the lines that are unique in both texts: the longest order that both share is the alignment (patience diff), and
    its anchors grow to blocks while the lines around them are equal. What moved is out of that order and makes alignments
    of its own. Then, among the lines of b that no block has taken yet, those that a has up to 1, 2, 4, 8 and 16 times, each
    with all its places in a, so that repeated blocks are aligned as well; the rest, lines that a repeats more often, with
    one place for each copy in turn. A common block is missed only where every line of it is so often in a and no copy met
    its own place (periodic texts). All steps take time in proportion to the lines, but for a logarithm.
    """
    first, second, weight = a.tolist(), b.tolist(), words.tolist()
    places: dict[int, list[int]] = {}
    wanted = set(second)
    for i, h in enumerate(first):
        if h in wanted:
            places.setdefault(h, []).append(i)
    left = [h in places for h in second]
    out: list[tuple[int, int]] = []
    for copies in (0, *COPIES, None):  # 0: unique in both
        mine: dict[int, list[int]] = {}
        for j, h in enumerate(second):
            if left[j] and (copies is None or len(places[h]) <= max(copies, 1)):
                mine.setdefault(h, []).append(j)
        pairs = []
        for h, own in mine.items():
            theirs = places[h]
            if copies == 0 and len(own) > 1:
                continue
            pairs += [(theirs[k % len(theirs)], j) for k, j in enumerate(own)] if copies is None else [(i, j) for j in own for i in theirs]
        pairs.sort(key=lambda p: (p[0], -p[1]))
        for anchors in _chains(pairs):
            for s, e in _grown(anchors, first, second, weight, least):
                left[s:e] = [False] * (e - s)
                out.append((s, e))
        if not any(left):
            break
    return _merged(out)


def _merged(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(blocks):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _grown(anchors: list[tuple[int, int]], first: list[int], second: list[int], weight: list[int], least: int) -> list[tuple[int, int]]:
    out, done, shift = [], 0, None
    for i, j in anchors:
        if j < done and shift == i - j:
            continue
        s, e = j, j + 1
        while s > 0 and s + i - j > 0 and first[s + i - j - 1] == second[s - 1]:
            s -= 1
        while e < len(second) and e + i - j < len(first) and first[e + i - j] == second[e]:
            e += 1
        done, shift = e, i - j
        if sum(weight[s:e]) >= least:
            out.append((s, e))
    return out


def line_table(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, lines, words, numbers, runs): int64, int32, int32 and int64 arrays as binaries, of the texts with a non-null id."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text <> ''")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = lines_of(text_bytes(batch, "text"))
        columns = [[a.tobytes() for a in part] for part in zip(*found)]
        own_runs = [np.unique(runs(h, w, least_words)[0]) for h, w, _ in found]
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in own_runs]))), pa.int32()), pa.array(np.concatenate(own_runs)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns), flat], ["id", "lines", "words", "numbers", "runs"])

    return map_slices(source, run, "text", f"id {dict(source.dtypes)['id']}, lines binary, words binary, numbers binary, runs array<bigint>")


def shared_lines(docs: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, spans): the line numbers [start, stop) that go from each text that loses any.

    A text that many later ones share runs with would be one key of a join; pairs are salted by the later text, and the
    owner's lines go to the salts that have pairs.
    """
    table = materialize(line_table(docs, id_col, text_col, least_words), "line-table")
    owned = table.select("id", F.explode("runs").alias("run"))
    owners = owned.groupBy("run").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("texts")).where("owner < last")
    owners = materialize(owners.select("run", "owner", "texts"), "run-owners")
    rare, common = (owners.where(f"texts {than} {RARE_TEXTS}").select("run", "owner") for than in ("<=", ">"))
    met = owned.join(rare, "run").unionByName(salted_join(owned, common, "run", "id").select("run", "id", "owner"))
    pairs = met.where("id > owner").select("owner", "id").distinct()
    pairs = materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "line-pairs")
    later = table.select("id", F.col("lines").alias("b"), "words", "numbers")
    first = table.select(F.col("id").alias("owner"), F.col("lines").alias("a"))
    first = pairs.select("owner", "salt").distinct().join(first, "owner")
    aligned = pairs.join(later, "id").join(first, ["owner", "salt"]).select("id", "a", "b", "words", "numbers")
    kind = dict(aligned.dtypes)["id"]

    def run(batches):
        for batch in batches:
            spans = []
            for a, b, words, numbers in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "words", "numbers"))):
                at = np.frombuffer(numbers, dtype=np.int32)
                blocks = shared_blocks(np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64), np.frombuffer(words, dtype=np.int32), least_words)
                spans.append([{"start": int(at[s]), "stop": int(at[e - 1]) + 1} for s, e in blocks])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["id", "spans"])
        release()

    found = aligned.mapInArrow(run, f"id {kind}, spans array<struct<start:int,stop:int>>").where("size(spans) > 0")
    return found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, text, n_lines, n_deleted): each row as a struct, its text without the blocks that an earlier text has.

    The lines go that alignments with earlier texts put into common blocks of least_words words or more (of one line at
    least); 1 takes every repeated line. See shared_blocks for what an alignment can miss. A text is earlier if its id is smaller; rows with equal ids aren't
    compared with each other and lose the same line numbers, as the same document. Null ids, null and empty texts stay as
    they are; a null text has 0 lines. Of exact copies all but the first lose all such lines. Very long texts are compared
    whole, in time in proportion to their lines. An empty table gives no rows. Columns of any name pass through in the
    struct.
    """
    gone = shared_lines(docs, id_col, text_col, least_words).withColumnRenamed("id", "gone_id")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("key"), docs[text_col].alias("text"))
    joined = rows.join(gone, rows["key"] == gone["gone_id"], "left")

    def cut(batch: pa.RecordBatch) -> pa.Array:
        out = []
        for text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                out.append(None)
                continue
            lines = text.split("\n")
            stays = bytearray(b"\x01") * len(lines)
            for s in spans or ():
                stays[s["start"] : s["stop"]] = bytes(s["stop"] - s["start"])
            kept = [x for x, stay in zip(lines, stays) if stay]
            out.append({"text": "\n".join(kept), "deleted": len(lines) - len(kept)})
        return pa.array(out, pa.struct([("text", pa.string()), ("deleted", pa.int64())]))

    touched = F.col("spans").isNotNull()  # other texts don't go to Python
    done = joined.withColumn("cut", by_text(docs.sparkSession, cut, "struct<text: string, deleted: bigint>", F.when(touched, F.col("text")), F.col("spans")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return done.select("row", F.when(touched, F.col("cut.text")).otherwise(F.col("text")).alias("text"), n_lines.alias("n_lines"), F.when(touched, F.col("cut.deleted")).otherwise(F.lit(0)).cast("long").alias("n_deleted"))
