"""Jobs from their events, as typed state that grows with a job's events and is dropped a day after the last one.

An event is (job_id, seq, event, no, total, text, status, message, done_count): ``text`` is what a delta adds or the partial text of a snapshot, ``status`` and
``message`` are those of an end. Events may come in any order and more than once; each value remembers the seq that set it, so the state is
always that of all events so far in the order of seq. A snapshot stands for everything before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "job_id long, seq long, event string, no int, total int, text string, status string, message string, done_count int"
SHOWN = "total int, done int, current_no int, partial string, status string, error string, last_error string, last_seq long"
EXPIRE_MS = 24 * 3600 * 1000
ACTIVE = ("queued", "running")

#: Typed state of a job: values with the seq that set each, the seq of the last snapshot and of the last boundary of partial text (doubled; a snapshot's own text lies behind its boundary), and what is counted.
HEAD = "total int, total_seq long, current int, current_seq long, status string, status_seq long, error string, last_error string, error_seq long, boundary long, base_seq long, done int, last_seq long"
_NAMES = [f.split()[0] for f in HEAD.split(", ")]
_FIRST: dict[str, Any] = dict.fromkeys(_NAMES) | {"total": 0, "status": "queued", "done": 0}


def _value(x: Any) -> Any:
    return None if x is None or x is pd.NA or x != x else x


def _number(x: Any) -> int | None:
    return None if _value(x) is None else int(x)


def folded(head: dict, seen: Any, pieces: Any, rows: pd.DataFrame) -> dict:
    """Events onto a job's state. ``seen``: seq to whether it is counted as done; ``pieces``: doubled seq to text; both as mappings."""

    def later(what: str, seq: int) -> bool:
        if head[what] is not None and seq <= head[what]:
            return False
        head[what] = seq
        return True

    for r in rows.itertuples(index=False):
        seq, kind, text, no = int(r.seq), r.event, _value(r.text), _number(r.no)
        if seq in seen:
            continue
        ends = kind in ("done", "error")
        counted = ends and (head["base_seq"] is None or seq > head["base_seq"])
        seen[seq] = bool(counted)
        head["done"] += counted
        head["last_seq"] = seq if head["last_seq"] is None else max(seq, head["last_seq"])
        snapshot, total = kind == "snapshot", _number(r.total)
        if (snapshot or (kind == "start" and total is not None)) and later("total_seq", seq):
            head["total"] = total or 0
        if (snapshot or kind in ("problem", "end")) and later("current_seq", seq):
            head["current"] = None if kind == "end" else no
        if (snapshot or kind in ("start", "end")) and later("status_seq", seq):
            head["status"] = _value(r.status) or {"end": "done"}.get(kind, "running") if kind != "start" else "running"
            head["error"] = _value(r.message) if kind == "end" else None
        if kind == "error" and _value(r.message) is not None and later("error_seq", seq):
            head["last_error"] = r.message
        bound = 2 * seq - 1 if snapshot else 2 * seq
        if (snapshot or ends or kind == "problem") and later("boundary", bound):
            for k in [k for k in pieces if k < bound]:
                del pieces[k]
        if (snapshot or kind == "delta") and text and (head["boundary"] is None or 2 * seq > head["boundary"]):
            pieces[2 * seq] = text
        if snapshot and (head["base_seq"] is None or seq > head["base_seq"]):
            head["base_seq"] = seq
            done = [k for k in seen if seen[k]]
            for k in done:
                if k < seq:
                    seen[k] = False
            head["done"] = (_number(r.done_count) or 0) + sum(k > seq for k in done)
    return head


def shown(head: dict, pieces: Any) -> list:
    return [head["total"], head["done"], head["current"], "".join(pieces[k] for k in sorted(pieces)), head["status"], head["error"], head["last_error"], head["last_seq"]]


class _Map:
    """A map state of one value column as a mapping."""

    def __init__(self, state, of: tuple = ()):
        self.state, self.of = state, of

    def __contains__(self, k) -> bool:
        return self.state.containsKey((*self.of, k))

    def __getitem__(self, k):
        return self.state.getValue((*self.of, k))[0]

    def __setitem__(self, k, v) -> None:
        self.state.updateValue((*self.of, k), (v,))

    def __delitem__(self, k) -> None:
        self.state.removeKey((*self.of, k))

    def __iter__(self):
        return iter([k[-1] for k in self.state.keys() if tuple(k[: len(self.of)]) == self.of])


def _renewed(handle: StatefulProcessorHandle, now: int) -> None:
    """One timer a key: a day from now."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)
    handle.registerTimer(now + EXPIRE_MS)


class JobState(StatefulProcessor):
    """The state of one job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.seen = handle.getMapState("seen", "seq long", "counted boolean")
        self.pieces = handle.getMapState("pieces", "at long", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head = dict(zip(_NAMES, self.head.get())) if self.head.exists() else dict(_FIRST)
        pieces = _Map(self.pieces)
        for part in rows:
            folded(head, _Map(self.seen), pieces, part)
        self.head.update(tuple(head[n] for n in _NAMES))
        _renewed(self.handle, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame([[key[0], *shown(head, pieces)]], columns=["job_id", *(f.split()[0] for f in SHOWN.split(", "))]).astype({"current_no": "Int32"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Stored totals of a job whose state has expired: as a snapshot at its last seq."""
        r = initialState.iloc[0]
        head, seen, pieces = dict(_FIRST), {}, {}
        stored = pd.DataFrame([{"seq": r.last_seq, "event": "snapshot", "no": r.current_no, "total": r.total, "text": r.partial, "status": r.status, "message": None, "done_count": r.done}])
        folded(head, seen, pieces, stored)
        head["error"], head["last_error"] = _value(r.error), _value(r.last_error)
        self.head.update(tuple(head[n] for n in _NAMES))
        _Map(self.seen)[int(r.last_seq)] = False
        for k, t in pieces.items():
            _Map(self.pieces)[k] = t
        _renewed(self.handle, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.head, self.seen, self.pieces):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


class ExamState(StatefulProcessor):
    """The jobs of one kind of an exam. Texts are not kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState("heads", "job_id long", HEAD)
        self.seen = handle.getMapState("seen", "job_id long, seq long", "counted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for job, events in part.groupby("job_id"):
                job = int(job)
                head = dict(zip(_NAMES, self.heads.getValue((job,)))) if self.heads.containsKey((job,)) else dict(_FIRST)
                folded(head, _Map(self.seen, (job,)), {}, events)
                self.heads.updateValue((job,), tuple(head[n] for n in _NAMES))
        active = [h for h in (dict(zip(_NAMES, v)) for v in self.heads.values()) if h["status"] in ACTIVE]
        done, total = sum(h["done"] for h in active), sum(max(h["total"], h["done"] + (h["current"] is not None)) for h in active)
        _renewed(self.handle, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame([[*key, len(active), done, total]], columns=["node_id", "kind", "active", "done", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.heads.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def progress(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """X1, X2 as a stream: events to the row of each job they touch, the same as ``progress_batch`` gives for all events so far.

    A job's state goes a day after its last event. ``stored``: rows of this very result from before, which such jobs go on from. Needs the RocksDB state store.
    """
    start = None if stored is None else stored.groupBy("job_id")
    return events.groupBy("job_id").transformWithStateInPandas(JobState(), f"job_id long, {SHOWN}", "update", "processingTime", start)


def progress_batch(events: DataFrame) -> DataFrame:
    """X1, X2 over stored events, with windows and aggregates only: one row for each job. An event that is there twice counts once."""
    events = events.dropDuplicates(["job_id", "seq"])
    base = Window.partitionBy("job_id")
    e = events.withColumn("base", F.max(F.when(F.col("event") == "snapshot", F.col("seq"))).over(base)).withColumn("last_seq", F.max("seq").over(base))
    e = e.withColumn("last_error", F.max_by("message", F.when((F.col("event") == "error") & F.col("message").isNotNull(), F.col("seq"))).over(base))
    e = e.filter(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
    is_ = lambda *kinds: F.col("event").isin(*kinds)
    ends = is_("problem", "done", "error", "snapshot")
    e = e.withColumn("piece", F.sum(F.when(ends, 1).otherwise(0)).over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda value, *kinds: F.max_by(value, F.when(is_(*kinds), F.col("seq")))
    status = F.when(is_("end"), F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("done"))).when(is_("snapshot"), F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("running"))).when(is_("start"), "running")
    jobs = e.groupBy("job_id").agg(
        F.coalesce(F.max_by(F.coalesce("total", F.lit(0)), F.when(is_("snapshot") | (is_("start") & F.col("total").isNotNull()), F.col("seq"))), F.lit(0)).alias("total"),
        (F.count(F.when(is_("done", "error"), 1)) + F.coalesce(F.max(F.when(is_("snapshot"), F.col("done_count"))), F.lit(0))).cast("int").alias("done"),
        last(F.when(~is_("end"), F.col("no")), "problem", "end", "snapshot").alias("current_no"),
        F.coalesce(last(status, "start", "end", "snapshot"), F.lit("queued")).alias("status"),
        last(F.when(is_("end"), F.col("message")), "start", "end", "snapshot").alias("error"),
        F.first("last_error").alias("last_error"), F.first("last_seq").alias("last_seq"), F.max("piece").alias("piece"),
    )
    # the text since the last problem, done, error or snapshot, with the snapshot's own
    tail = e.filter(is_("delta", "snapshot")).groupBy("job_id", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("partial"))
    j = jobs.join(tail, ["job_id", "piece"], "left")
    return j.select("job_id", "total", "done", "current_no", F.coalesce("partial", F.lit("")).alias("partial"), "status", "error", "last_error", "last_seq")


def exam_progress(jobs: DataFrame, kind: str) -> DataFrame:
    """By exam, jobs of a kind that are active: done, and the total, which is never below done plus the one running."""
    active = jobs.filter((F.col("kind") == kind) & F.col("status").isin(*ACTIVE))
    running = F.when(F.col("current_no").isNotNull(), 1).otherwise(0)
    return active.groupBy("node_id").agg(F.sum("done").cast("long").alias("done"), F.sum(F.greatest(F.col("total"), F.col("done") + running)).cast("long").alias("total"))


def exam_progress_stream(events: DataFrame) -> DataFrame:
    """X3 as a stream: events with node_id and kind to (node_id, kind, active, done, total) of the exams they touch. ``active`` 0 withdraws the exam's row: no job of the kind is left."""
    return events.groupBy("node_id", "kind").transformWithStateInPandas(ExamState(), "node_id long, kind string, active long, done long, total long", "update", "processingTime")
