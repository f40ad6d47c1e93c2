"""Applying a model backend to a DataFrame.

The backend runs inside an Arrow UDF that only receives
the prompt (and, for packs, the item texts): every other column stays in
the JVM, so single-row enrichment needs no join and no shuffle.  Its batches are
bounded in bytes, and a request becomes Python text only for its call.  Retries run
inside the task (the backend is not re-called by Spark task retry for
successful rows of a landed result); NULL prompts are never sent.

Because a model call is not free, ``land`` writes the answered frame once to a
Parquet table in the shared checkpoint folder (``spark.checkpoint.dir``);
downstream operators read the landed copy, so each request is paid for once per run.
"""
from __future__ import annotations

import heapq
import math
import queue
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import ship_package, state_path
from .backends import Backend

RESPONSE_T = "text string, error string, attempts int, latency_ms double, called_at double, task int"
_ARROW = {"text": pa.string(), "error": pa.string(), "attempts": pa.int32(), "latency_ms": pa.float64(), "called_at": pa.float64(), "task": pa.int32()}
#: Requests that a paced task holds at a time.
PACED_ROWS = 256
#: Seconds that a paced call may start late in its slot, however short the slots are.
PACED_LATE_S = 0.05
#: Bytes of requests that Spark hands to a Python worker at a time, whatever their number.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(frozen=True)
class RetryPolicy:
    """How failed calls are retried inside a task.

    ``kind='linear'``: rate-limit errors wait ``rate_limit_delay*(k+1)``, others ``short_delay``.
    ``kind='exponential'``: every error waits ``base_delay * 2**k``.
    ``rpm``: calls a minute of the whole run, whatever its tasks: they share one row of start slots (``call_paced``).
    ``timeout_s``: the backend is told it (``Backend.timeout_s``) and should end its request then.  A call that goes on all
    the same keeps its place and is not sent again; its answer is taken whenever it comes, and after ``give_up_factor``
    time-outs the request is an error.
    """

    max_attempts: int = fixed.MAX_RETRIES
    kind: str = "linear"
    rate_limit_delay: float = fixed.RETRY_DELAY_LINEAR_S
    short_delay: float = fixed.RETRY_DELAY_SHORT_S
    base_delay: float = fixed.RETRY_DELAY_EXP_BASE_S
    sleep: bool = True
    rpm: float | None = None
    timeout_s: float | None = None      # per single-row request; a pack request gets pack_timeout_factor times it
    pack_timeout_factor: float = 2.0
    give_up_factor: float = 10.0

    def delay(self, attempt: int, rate_limited: bool) -> float:
        if self.kind == "exponential":
            return self.base_delay * (2 ** attempt)
        return self.rate_limit_delay * (attempt + 1) if rate_limited else self.short_delay


class RateLimited(Exception):
    """Raised by a backend on HTTP 429; ``retry_after`` (seconds) is honoured when given."""

    def __init__(self, message: str = "HTTP 429 Too Many Requests", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def is_rate_limited(message: str | None) -> bool:
    m = (message or "").lower()
    return any(k in m for k in fixed.RATE_LIMIT_MARKERS)


class _Call(threading.Thread):
    """One call of a backend, with its own start and duration; its outcome is put on ``ended``."""

    def __init__(self, backend: Backend, i: int, prompt: str, items, attempt: int, ended: queue.SimpleQueue):
        super().__init__(daemon=True)
        self.args, self.i, self.attempt, self.ended = (backend, prompt, items), i, attempt, ended
        self.outcome: object = None
        self.started_at = self.seconds = 0.0
        self.began = time.monotonic()

    def run(self):
        backend, prompt, items = self.args
        self.started_at, self.began = time.time(), time.monotonic()
        try:
            self.outcome = backend.generate_one(prompt, items, self.attempt)
        except BaseException as e:  # noqa: BLE001 - failures are data here; what is no Exception ends the task
            self.outcome = e
        self.seconds = time.monotonic() - self.began
        self.ended.put(self)


@dataclass
class Slots:
    """The start slots of one of ``tasks`` tasks that agreed on ``began``: it may start a call in every ``tasks``-th slot from its
    own on.  Slots follow each other after ``interval`` seconds; each holds one call, which starts within ``late`` seconds (at
    least an interval), else the slot is lost.  So the run never catches up on more than that."""

    began: float
    interval: float
    task: int = 0
    tasks: int = 1
    at: int = 0
    late: float = 0.0

    @classmethod
    def of_rate(cls, began: float, rpm: float, task: int = 0, tasks: int = 1) -> Slots:
        """Slots of which no 60 seconds see more than ``rpm``, and one, begin.  A call is up to ``late`` seconds after its slot's
        begin, so the slots of 60 seconds and of those before them are no more than that."""
        late = max(60.0 / rpm, PACED_LATE_S)
        return cls(began, (60.0 + late) / (rpm + 1), task, tasks, late=late)

    def _time(self) -> float:
        return self.began + (self.at * self.tasks + self.task) * self.interval

    def next(self, now: float) -> float:
        """When this task's next free slot begins: now or earlier if it may be used at once."""
        late = max(self.interval, self.late)
        if now >= self._time() + late:
            self.at = max(self.at, math.floor(((now - late - self.began) / self.interval - self.task) / self.tasks))
            while now >= self._time() + late:
                self.at += 1
        return self._time()

    def take(self) -> None:
        self.at += 1


class _Values(Sequence):
    """An Arrow array as a sequence whose values become Python objects one at a time, each when it is asked for."""

    def __init__(self, array: pa.Array):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, i: int):
        return self.array[i].as_py()


def _nulls(values: Sequence) -> list[bool]:
    return values.array.is_null().to_pylist() if isinstance(values, _Values) else [v is None for v in values]


def _run_batch(backend: Backend, policy: RetryPolicy, prompts: Sequence, items: Sequence, slots: Slots | None = None) -> pd.DataFrame:
    """Answers to a batch of prompts, up to ``backend.max_concurrency`` at a time.

    Each request has its own clock and its own retries: a request that waits delays no other.  A call is under way until it ends;
    until then it counts against the width, and its request is not sent again.  An answer is taken whenever it comes, unless
    the request was given up (``RetryPolicy.give_up_factor``).  With ``slots`` (wall-clock times) a call starts in a slot.
    """
    from pyspark import TaskContext

    ctx = TaskContext.get()
    task = ctx.partitionId() if ctx is not None else -1
    n = len(prompts)
    rows = [{"text": None, "error": None, "attempts": 0, "latency_ms": 0.0, "called_at": None, "task": None} for _ in range(n)]
    width = max(1, backend.max_concurrency)
    inline = width == 1 and not policy.timeout_s
    waiting = [(0.0, i, 0) for i, null in enumerate(_nulls(prompts)) if not null]  # when ready, request, attempt
    single = _nulls(items)
    heapq.heapify(waiting)
    live: dict[int, _Call] = {}
    ended: queue.SimpleQueue = queue.SimpleQueue()

    def limit(i: int) -> float:
        return policy.timeout_s * (1.0 if single[i] else policy.pack_timeout_factor) if policy.timeout_s else float("inf")

    def settle(i: int, attempt: int, outcome) -> None:
        row, retry_after = rows[i], None
        if isinstance(outcome, BaseException):
            row["error"] = f"{type(outcome).__name__}: {outcome}"
            retry_after = getattr(outcome, "retry_after", None)
        elif outcome is None or str(outcome).strip() == "":
            row["error"] = fixed.EMPTY_RESPONSE
        else:
            row["text"], row["error"] = str(outcome), None
            return
        if attempt + 1 < policy.max_attempts:
            wait = float(retry_after) if retry_after is not None else policy.delay(attempt, is_rate_limited(row["error"]))
            heapq.heappush(waiting, (time.monotonic() + (wait if policy.sleep else 0.0), i, attempt + 1))

    def finish(call: _Call) -> None:
        rows[call.i]["latency_ms"] += call.seconds * 1000
        if isinstance(call.outcome, BaseException) and not isinstance(call.outcome, Exception):
            raise call.outcome
        if live.get(call.i) is call:
            del live[call.i]
            settle(call.i, call.attempt, call.outcome)

    def pause(now: float) -> float:
        """Seconds until another call may start."""
        wait = waiting[0][0] - now
        return max(wait, slots.next(time.time()) - time.time()) if slots else wait

    while waiting or live:
        now = time.monotonic()
        while waiting and len(live) < width and pause(now) <= 0:
            _, i, attempt = heapq.heappop(waiting)
            if slots:
                slots.take()
            call = _Call(backend, i, prompts[i], items[i], attempt, ended)
            rows[i]["attempts"] += 1
            rows[i]["task"] = task
            if rows[i]["called_at"] is None:
                rows[i]["called_at"] = time.time()
            live[i] = call
            if inline:
                call.run()
                finish(ended.get())
                now = time.monotonic()
            else:
                call.start()
        if not live:
            if waiting:
                time.sleep(max(pause(time.monotonic()), 0.0))
            continue
        # until a call ends, one is given up, or another may start
        now = time.monotonic()
        left = min(c.began + limit(i) * policy.give_up_factor for i, c in live.items()) - now
        if waiting and len(live) < width:
            left = min(left, pause(now))
        try:
            finish(ended.get(timeout=None if left == float("inf") else max(left, 0.001)))
        except queue.Empty:
            pass
        now = time.monotonic()
        for i, c in [(i, c) for i, c in live.items() if now - c.began >= limit(i) * policy.give_up_factor]:
            del live[i]
            rows[i]["latency_ms"] += (now - c.began) * 1000
            rows[i]["error"] = f"TimeoutError: Timeout after {limit(i)}s, given up after {limit(i) * policy.give_up_factor:g}s"
    return pd.DataFrame(rows, columns=["text", "error", "attempts", "latency_ms", "called_at", "task"])


def _opened(backend: Backend, policy: RetryPolicy) -> Backend:
    if not getattr(backend, "_weft_open", False):
        backend.timeout_s = policy.timeout_s
        backend.open()
        backend._weft_open = True
    return backend


def _answers(answers: pd.DataFrame) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(answers[c].astype(object).where(answers[c].notna(), None), t) for c, t in _ARROW.items()], names=list(_ARROW))


def bound_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches have BATCH_BYTES at most; a smaller limit of its own stays."""
    own = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if own <= 0 or own > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def model_udf(backend: Backend, policy: RetryPolicy | None = None):
    """A non-deterministic Arrow UDF ``(prompt, items) -> struct<text, error, attempts, latency_ms, called_at, task>``
    (``called_at``: epoch seconds of the first attempt; ``task``: the Spark partition that made the call)."""
    pol = policy or RetryPolicy()
    bk = backend
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)

    @F.arrow_udf(RESPONSE_T)
    def _call(prompts: pa.Array, items: pa.Array) -> pa.Array:
        return _answers(_run_batch(_opened(bk, pol), pol, _Values(prompts), _Values(items)))

    return _call.asNondeterministic()


def call_model(df: DataFrame, backend: Backend, prompt: str | Column = "prompt", items: str | Column | None = None,
               policy: RetryPolicy | None = None, out: str = "response") -> DataFrame:
    """Add ``out`` = struct<text, error, attempts, latency_ms, called_at, task>; rows with a NULL prompt are not sent."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    it = (F.col(items) if isinstance(items, str) else items) if items is not None else F.lit(None).cast("array<string>")
    bound_batches(df.sparkSession)
    if policy is not None and policy.rpm and policy.sleep:
        return call_paced(df, backend, p, it, policy, out)
    return df.withColumn(out, model_udf(backend, policy)(p, it))


def call_paced(df: DataFrame, backend: Backend, prompt: Column, items: Column, policy: RetryPolicy, out: str = "response") -> DataFrame:
    """``call_model`` at ``policy.rpm`` calls a minute over all tasks.

    The calls are made in one barrier stage of as many tasks as the cluster runs at a time: they start together, agree on the
    moment and on how many they are, and deal the start slots among themselves in turn.  No task counts on another's
    number being right, and none waits for another afterwards.  The stage's rows travel with the requests."""
    spark = df.sparkSession
    ship_package(spark)
    rpm = policy.rpm
    columns = df.columns
    asked = df.select(*columns, prompt.alias("_p"), items.alias("_i")).repartition(max(1, spark.sparkContext.defaultParallelism))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StructType.fromDDL(RESPONSE_T))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        began = max(map(float, ctx.allGather(repr(time.time()))))
        slots = Slots.of_rate(began, rpm, ctx.partitionId(), len(ctx.getTaskInfos()))
        for batch in batches:
            for a in range(0, batch.num_rows, PACED_ROWS):
                part = batch.slice(a, PACED_ROWS)
                answers = _run_batch(_opened(backend, policy), policy, _Values(part.column("_p")), _Values(part.column("_i")), slots)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], _answers(answers)], names=[*columns, out])

    return asked.mapInArrow(run, schema, barrier=True)


def land(df: DataFrame, name: str = "landed") -> DataFrame:
    """Write once as a Parquet table in the shared checkpoint folder and read it back.

    One job computes each partition once (``Dataset.checkpoint`` would compute the
    plan a second time to write the checkpoint, i.e. call the model twice); the
    returned frame reads the written files, so later actions never re-ask.
    """
    spark = df.sparkSession
    path = state_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
