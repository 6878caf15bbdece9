"""Operator 6, WARC: the capture index of pages, merged externally into capture histories.

A capture is a row of pages.  Its URL key is canonical (urlkey()): lower case, without scheme, user, leading 'www.', port 80
and 443, fragment, tracking parameters and a last '/', with the host's labels reversed: 'com,example,news)/path?query'.
Its timestamp is a column of pages if `time_column` names one; the driver's pages have none, so page_id, the order of
capture, stands for it.  The digest is the MD5 of the page.

index(): a row for each capture in global order of (urlkey, ts, page_id): urlkey, ts, page_id, url, digest, n_bytes,
capture_no (from 1 in its URL's history), n_prior_same (earlier captures of that URL with that digest just before it, in a
row), revisit (the same digest as the capture before it).

Plan: index entries (not the pages) are sampled for range bounds on the whole sort key, so that a URL with a long history
spans several ranges.  Each scan task sorts RUN entries at a time, and cuts the run at the bounds and into batches of
BATCH entries, which are written to the shared folder.  The batches are put in the order of ranges and of their first
entries (one exchange; a batch is a row), and each range is merged as a stream: a loser tree over the open batches gives
the next entries, all up to the runner-up's first at once; a batch is opened when its first entry is due, so a task holds
no more than a batch or two of each run, however long the range is.  The merged entries are the result as they come: the
tasks are in the order of ranges, and nothing is sorted after the merge.  What a range's first history carries on from
the ranges before is found by merging twice, the first time for a row a range (MOST_RANGES at most, then broadcast).

Defined cases: a null url has the null key '' and is one history; null pages have a null digest, equal to each other's; null
timestamps come first; ties in (urlkey, ts) are ordered by page_id, digest and url (nulls first); repeated rows are captures
of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import give_back, pieces, plan_bytes, written

#: Parquet bytes of pages whose captures make a range, and the most ranges: beyond, they are larger.
RANGE_BYTES, MOST_RANGES = 8 << 20, 8192
#: Entries of a run, of a batch, and of the samples for each range's bounds.
RUN, BATCH, SAMPLES = 1 << 18, 1 << 12, 16
TRACKING = "utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|sid"
KEYS = ("urlkey", "ts", "page_id", "digest", "url")
ENTRY = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("url", pa.string()), ("n_bytes", pa.int64())])


def _steps(lower, replace):
    """The canonical form in steps that Spark and SQL share: replace(expression, regular expression, replacement)."""
    x = lower
    x = replace(x, "#.*$", "")
    x = replace(x, "^[a-z][a-z0-9+.-]*://", "")
    x = replace(x, "^[^/?@]*@", "")
    x = replace(x, "^www[0-9]*\\.", "")
    x = replace(x, "^([^/?:]*):(80|443)([/?]|$)", "REF1REF3")
    x = replace(x, f"([?&])({TRACKING})=[^&]*", "REF1")
    x = replace(x, "&+", "&")
    x = replace(x, "[?]&", "?")
    x = replace(x, "[?&]+$", "")
    return replace(x, "/$", "")


def urlkey(url: Column) -> Column:
    def replace(x: Column, pattern: str, to: str) -> Column:
        return F.regexp_replace(x, pattern, to.replace("REF", "$"))

    plain = _steps(F.lower(F.trim(F.coalesce(url, F.lit("")))), replace)
    host = F.regexp_extract(plain, "^([^/?]*)", 1)
    rest = F.regexp_replace(plain, "^[^/?]*", "")
    return F.when(plain == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest))


def _key_sql(url: str) -> str:
    def replace(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to.replace('REF', chr(92))}', 'g')"

    return _steps(f"lower(trim(coalesce({url}, '')))", replace)


class LoserTree:
    """A tournament of runs: inner nodes hold losers, the root the run with the least head."""

    def __init__(self, heads: list):
        self.k = len(heads)
        self.heads = heads
        self.node = [-1] * max(1, self.k)
        self.best = -1
        for i in range(self.k):
            self._play(i, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int, building: bool = False) -> None:
        at = (i + self.k) // 2
        while at > 0:
            other = self.node[at]
            if building and other < 0:
                self.node[at] = i
                return
            if self._less(other, i):
                self.node[at], i = i, other
            at //= 2
        self.best = i

    def replace(self, head) -> None:
        self.heads[self.best] = head
        self._play(self.best)

    def runner_up(self):
        """The least head but the winner's, and its run."""
        at, found = (self.best + self.k) // 2, -1
        while at > 0:
            if found < 0 or self._less(self.node[at], found):
                found = self.node[at]
            at //= 2
        return (None, -1) if found < 0 else (self.heads[found], found)


def merged(batches: Iterator[tuple[tuple, Callable[[], list[tuple]]]]) -> Iterator[tuple[int, int, int]]:
    """The order of the entries of sorted batches, as slices (batch, from, to).

    Batches come as (first entry, function that gives all entries), in the order of first entries, and are opened when
    that is due.
    """
    waiting = enumerate(batches)
    number, (due, load) = next(waiting, (-1, (None, None)))
    opened: list[list] = []  # number, entries, place
    while True:
        tree = LoserTree([entries[at] for _, entries, at in opened])
        while opened:
            run = tree.best
            head = tree.heads[run]
            if head is None or due is not None and due <= head:
                break
            which, entries, begin = opened[run]
            limit, other = tree.runner_up()
            own = (run, other)
            if due is not None and (limit is None or due < limit):
                limit, own = due, (0, 0)
            end = begin + 1
            # gallop: all that come before the limit (equal ones go by the number of their batch)
            if limit is None:
                end = len(entries)
            else:
                step = 1
                while end < len(entries) and (entries[end], own[0]) < (limit, own[1]):
                    end = min(len(entries), end + step)
                    step *= 2
                low, high = begin + 1, end
                while low < high:
                    mid = (low + high) // 2
                    if (entries[mid], own[0]) < (limit, own[1]):
                        low = mid + 1
                    else:
                        high = mid
                end = low
            yield which, begin, end
            opened[run][2] = end
            tree.replace(entries[end] if end < len(entries) else None)
        opened = [x for x in opened if x[2] < len(x[1])]
        if due is None:
            if not opened:
                return
            continue
        opened.append([number, load(), 0])
        number, (due, load) = next(waiting, (-1, (None, None)))


def _tuples(columns: list) -> list[tuple]:
    return [tuple((v is not None, v) for v in row) for row in zip(*columns)]


def _sort_keys(table: pa.Table) -> list[tuple]:
    return _tuples([table.column(c).to_pylist() for c in KEYS])


def _order(table: pa.Table) -> np.ndarray:
    keys = [(c, "ascending") for c in KEYS]
    return pc.sort_indices(table, sort_keys=keys, null_placement="at_start")


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ENTRY) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(raw: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _runs(bounds: list[tuple]):
    limits = _tuples(list(zip(*bounds))) if bounds else []

    def run_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).select(ENTRY.names).cast(ENTRY)
        table = table.take(_order(table)).combine_chunks()

        def key(i: int) -> tuple:
            return tuple((v is not None, v) for v in (table.column(c)[i].as_py() for c in KEYS))

        n = table.num_rows
        cut = [0, *[bisect.bisect_left(range(n), b, key=key) for b in limits], n]
        rows = [(r, at, min(BATCH, cut[r + 1] - at)) for r in range(len(cut) - 1) for at in range(cut[r], cut[r + 1], BATCH)]
        first = table.select(KEYS).take(pa.array([at for _, at, _ in rows], pa.int64()))
        packed = pa.array([_bytes(table.slice(at, k)) for _, at, k in rows], pa.binary())
        yield from pa.table([pa.array([r for r, _, _ in rows], pa.int32()), *first.columns, packed], names=["range", *KEYS, "packed"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= RUN:
                yield from run_of(held)
                held, n = [], 0
        if held:
            yield from run_of(held)

    return run


RUNS = "range int, urlkey string, ts long, page_id long, digest string, url string, packed binary"
INDEX = "urlkey string, ts long, page_id long, url string, digest string, n_bytes long, capture_no long, n_prior_same long, revisit boolean"
ENDS = "range int, head_key string, head_digest string, last_key string, last_digest string, number long, streak long, one_key boolean, one_digest boolean"


class Numbers:
    """Counts captures along merged entries: of the last one its key, digest, number, and how many before it in a row
    have its key and digest."""

    def __init__(self, key: str | None = None, digest: str | None = None, number: int = 0, streak: int = -1):
        self.key, self.digest, self.number, self.streak = key, digest, number, streak

    def next(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """capture_no and n_prior_same of the next entries."""
        n = table.num_rows
        keys, digests = (table.column(c).combine_chunks().dictionary_encode() for c in ("urlkey", "digest"))
        url, digest = np.asarray(keys.indices), np.asarray(digests.indices.fill_null(-1))
        new = np.ones(n, bool)
        new[1:] = url[1:] != url[:-1]
        first = np.flatnonzero(new)
        number = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])) + 1
        other = new.copy()
        other[1:] |= digest[1:] != digest[:-1]
        begin = np.flatnonzero(other)
        streak = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
        if table.column("urlkey")[0].as_py() == self.key:
            number[: first[1] if len(first) > 1 else n] += self.number
            if table.column("digest")[0].as_py() == self.digest:
                streak[: begin[1] if len(begin) > 1 else n] += self.streak + 1
        self.key, self.digest = table.column("urlkey")[n - 1].as_py(), table.column("digest")[n - 1].as_py()
        self.number, self.streak = int(number[-1]), int(streak[-1])
        return number, streak


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Table]]]:
    """Each range's number, and its merged entries in tables; to be taken in turn."""
    rows = ((b, i) for b in batches for i in range(b.num_rows))
    state = {"next": next(rows, None)}

    def number(row) -> int:
        return row[0].column("range")[row[1]].as_py()

    def tables(r: int) -> Iterator[pa.Table]:
        held: dict[int, pa.Table] = {}

        def pending():
            at = 0
            while state["next"] is not None and number(state["next"]) == r:
                b, i = state["next"]
                state["next"] = next(rows, None)
                raw = b.column("packed")[i].as_buffer()

                def load(raw=raw, at=at):
                    held[at] = _table(raw)
                    return _sort_keys(held[at])

                yield tuple((v is not None, v) for v in (b.column(c)[i].as_py() for c in KEYS)), load
                at += 1

        parts, n = [], 0
        for which, begin, end in merged(pending()):
            parts.append(held[which].slice(begin, end - begin))
            n += end - begin
            if end == held[which].num_rows:
                del held[which]
            if n >= 1 << 14:
                yield pa.concat_tables(parts).combine_chunks()
                parts, n = [], 0
        if parts:
            yield pa.concat_tables(parts).combine_chunks()

    while state["next"] is not None:
        r = number(state["next"])
        yield r, tables(r)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range's first and last history tell to the ranges after it."""
    for r, tables in _ranges(batches):
        numbers, head, n = Numbers(), None, 0
        for table in tables:
            head = head or (table.column("urlkey")[0].as_py(), table.column("digest")[0].as_py())
            numbers.next(table)
            n += table.num_rows
        row = {"range": r, "head_key": head[0], "head_digest": head[1], "last_key": numbers.key, "last_digest": numbers.digest, "number": numbers.number, "streak": numbers.streak, "one_key": numbers.number == n, "one_digest": numbers.streak == n - 1}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("range", pa.int32()), *[(c, pa.string()) for c in ("head_key", "head_digest", "last_key", "last_digest")], ("number", pa.int64()), ("streak", pa.int64()), ("one_key", pa.bool_()), ("one_digest", pa.bool_())]))


def _index(before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, tables in _ranges(batches):
            numbers = Numbers(*before.value[r])
            for table in tables:
                number, streak = numbers.next(table)
                columns = [table.column(c).combine_chunks() for c in ("urlkey", "ts", "page_id", "url", "digest", "n_bytes")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int64()), pa.array(streak, pa.int64()), pa.array(streak > 0)], names=[f.split()[0] for f in INDEX.split(", ")])
        give_back()

    return run


def entries(pages: DataFrame, time_column: str | None = None) -> DataFrame:
    ts = F.col(time_column).cast("long") if time_column else F.col("page_id").cast("long")
    return pages.select(urlkey(F.col("url").cast("string")).alias("urlkey"), ts.alias("ts"), F.col("page_id").cast("long").alias("page_id"), F.md5(F.col("html").cast("string")).alias("digest"), F.col("url").cast("string").alias("url"), F.octet_length(F.col("html").cast("string")).cast("long").alias("n_bytes"))


def _bounds(found: DataFrame, ranges: int) -> list[tuple]:
    """Bounds of about equal ranges, from a sample of SAMPLES entries a range."""
    total = found.count()
    if ranges < 2 or not total:
        return []
    share = min(1.0, SAMPLES * ranges / total)
    sample = sorted(_tuples(list(zip(*[tuple(r) for r in found.select(*KEYS).sample(share, seed=6).collect()]))))
    return [tuple(v for _, v in sample[len(sample) * i // ranges]) for i in range(1, ranges)] if sample else []


def carried(ends: list) -> dict[int, tuple]:
    """What goes before each range: key, digest, number and streak of the last capture."""
    before: tuple = (None, None, 0, -1)
    out = {}
    for r in sorted(ends, key=lambda r: r["range"]):
        out[r["range"]] = before
        number, streak = r["number"], r["streak"]
        if r["one_key"] and before[0] == r["head_key"]:
            number += before[2]
        if r["one_digest"] and before[:2] == (r["head_key"], r["head_digest"]):
            streak += before[3] + 1
        before = (r["last_key"], r["last_digest"], number, streak)
    return out


def index(pages: DataFrame, time_column: str | None = None, ranges: int | None = None) -> DataFrame:
    """See the module's text.  The rows are in order: those of a task follow each other, and the tasks do."""
    ranges = ranges or min(pieces(plan_bytes(pages.select("url", "html"), "html"), RANGE_BYTES), MOST_RANGES)
    found = written(entries(pages, time_column), "captures")
    runs = written(found.mapInArrow(_runs(_bounds(found, ranges)), RUNS), "runs")
    ordered = runs.repartitionByRange(ranges, "range").sortWithinPartitions("range", *[F.asc_nulls_first(c) for c in KEYS])
    before = carried(ordered.mapInArrow(_ends, ENDS).collect())  # one row a range
    return ordered.mapInArrow(_index(pages.sparkSession.sparkContext.broadcast(before)), INDEX)


def oracle() -> str:
    """index()'s rows for the driver's pages, in DuckDB's SQL."""
    return f"""
WITH p AS (SELECT page_id, url, html, {_key_sql('url')} AS plain FROM pages),
k AS (SELECT page_id, url, md5(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes,
  CASE WHEN plain = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_extract(plain, '^([^/?]*)', 1), '.')), ',') || ')' || regexp_replace(plain, '^[^/?]*', '') END AS urlkey FROM p),
o AS (SELECT *, row_number() OVER w AS capture_no, lag(digest) OVER w AS prior, lag(page_id) OVER w AS prior_id FROM k WINDOW w AS (PARTITION BY urlkey ORDER BY page_id NULLS FIRST, digest NULLS FIRST)),
s AS (SELECT *, sum(CASE WHEN capture_no > 1 AND prior IS NOT DISTINCT FROM digest THEN 0 ELSE 1 END) OVER (PARTITION BY urlkey ORDER BY capture_no) AS run FROM o)
SELECT urlkey, page_id AS ts, page_id, url, digest, n_bytes, capture_no, row_number() OVER (PARTITION BY urlkey, run ORDER BY capture_no) - 1 AS n_prior_same,
  row_number() OVER (PARTITION BY urlkey, run ORDER BY capture_no) > 1 AS revisit FROM s"""
