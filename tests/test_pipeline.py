"""Packing invariants, paid-call accounting, plan shape, retries, resume and streaming."""
import hashlib
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weft.functions import fixed
from weft.operators import packing as PK
from weft.operators.backends import Backend, CallableBackend, FingerprintBackend
from weft.operators.backends import CountingBackend as Counting
from weft.operators.inference import RetryPolicy
from weft.plans.catalog import PROMPT, table
from weft.plans.enrich import EnrichSpec, enrich, pack_requests
from weft.plans.retry import enrich_with_fallback
from weft.streaming import incremental as INC

NO_SLEEP = RetryPolicy(sleep=False)


def CountingBackend(acc):
    return Counting(FingerprintBackend(), acc)


def docs(spark):
    return table(spark, SF_SMALL, "documents").select("doc_id", "text")


def test_pack_invariants(spark):
    d = docs(spark)
    for mode in ("bucketed", "ordered"):
        p = PK.pack(d, "doc_id", 5, mode=mode, n_buckets=7).collect()
        assert len(p) == d.count() and len({r.doc_id for r in p}) == len(p)
        packs = {}
        for r in p:
            packs.setdefault(r.batch_id, []).append(r.item_id)
        for ids in packs.values():
            assert sorted(ids) == list(range(1, len(ids) + 1)) and len(ids) <= 5
        if mode == "ordered":
            by_key = sorted(p, key=lambda r: r.doc_id)
            assert [(r.batch_id, r.item_id) for r in by_key] == [(i // 5, i % 5 + 1) for i in range(len(by_key))]


def test_plans_have_no_single_partition_exchange(spark):
    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), pack_size=5, n_buckets=8)
    plans = [
        pack_requests(d, spec)._jdf.queryExecution().executedPlan().toString(),
        PK.pack(d, "doc_id", 5, mode="ordered")._jdf.queryExecution().executedPlan().toString(),
    ]
    for p in plans:
        assert "SinglePartition" not in p
    # packing needs exactly one exchange: the bucket window and the pack grouping share it
    assert plans[0].count("Exchange") == 1


def test_calls_are_paid_once(spark):
    d = docs(spark)
    n = d.count()
    acc = spark.sparkContext.accumulator(0)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=CountingBackend(acc), policy=NO_SLEEP)
    out = enrich(d, spec)
    out.count()
    out.collect()
    assert acc.value == n  # landed once: later actions read the landed table
    acc2 = spark.sparkContext.accumulator(0)
    spec2 = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=CountingBackend(acc2), pack_size=5,
                       n_buckets=4, policy=NO_SLEEP)
    out2 = enrich(d, spec2)
    out2.collect()
    packs = pack_requests(d, spec2).filter("_has").count()
    assert acc2.value == packs and packs * 5 >= n > (packs - 4) * 5


def test_single_row_plan_has_no_exchange(spark):
    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP, land=False)
    plan = enrich(d, spec)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_retry_and_error_projection(spark):
    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP,
                      backend=FingerprintBackend(fail_prefixes="0123456789abcdef", fail_attempts=2))
    rows = enrich(d, spec).select("result.*", fixed.RESULT_COLUMN).collect()
    assert all(r.status == "OK" and r.attempts == 3 for r in rows)
    spec_dead = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP,
                           backend=FingerprintBackend(dead_prefixes="0123456789abcdef"))
    rows = enrich(d, spec_dead).select("result.*", fixed.RESULT_COLUMN).collect()
    assert all(r.status == "ERROR" and r[fixed.RESULT_COLUMN] == "Lỗi xử lý sau 3 lần thử" for r in rows)


def test_fallback_only_failed_packs(spark):
    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", pack_size=5, n_buckets=4, policy=NO_SLEEP,
                      backend=FingerprintBackend(poison_item_prefixes="0"))
    rows = enrich_with_fallback(d, spec).select("doc_id", "via", "result.status").collect()
    assert len(rows) == d.count() and all(r.status == "OK" for r in rows)
    assert {r.via for r in rows} == {"pack", "row"}


def test_resume_is_idempotent(spark, tmpdir_path):
    d = docs(spark)
    acc = spark.sparkContext.accumulator(0)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=CountingBackend(acc), policy=NO_SLEEP)
    path = os.path.join(tmpdir_path, "state")
    first = INC.run_incremental(d, spec, path, run_id=1)
    calls = acc.value
    second = INC.run_incremental(d, spec, path, run_id=2)
    assert acc.value == calls == d.count()  # the second run asks nothing
    assert sorted(tuple(r) for r in first.select("row_key", "ai_result").collect()) == \
        sorted(tuple(r) for r in second.select("row_key", "ai_result").collect())


def test_stream_second_run_asks_nothing(spark, tmpdir_path):
    d = docs(spark)
    src = os.path.join(tmpdir_path, "in")
    d.repartition(3).write.parquet(src)
    acc = spark.sparkContext.accumulator(0)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=CountingBackend(acc), policy=NO_SLEEP)
    state, ckpt = os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "ckpt")
    INC.enrich_stream(spark, src, d.schema, spec, state, ckpt, max_files_per_trigger=1).awaitTermination()
    calls = acc.value
    INC.enrich_stream(spark, src, d.schema, spec, state, ckpt, max_files_per_trigger=1).awaitTermination()
    assert acc.value == calls == d.count()
    assert INC.load_state(spark, state).count() == d.count()


def test_finalize_state():
    assert INC.finalize_state({"errors": 0, "remaining": 0}) is True
    assert INC.finalize_state({"errors": 1, "remaining": 0}) is False


def test_pacing_spaces_calls():
    import time as _t

    from weft.operators.inference import _run_batch

    from weft.operators.inference import Slots

    slots = Slots(_t.time(), 0.05)  # one call per 50 ms
    t0 = _t.perf_counter()
    out = _run_batch(FingerprintBackend(), RetryPolicy(rpm=1200), ["a", "b", "c", "d"], [None] * 4, slots)
    assert _t.perf_counter() - t0 >= 0.14 and out["error"].isna().all()
    starts = sorted(out["called_at"])
    assert len({int((x - slots.began) / 0.05 + 0.1) for x in starts}) == 4
    # three tasks share the slots; one that was late does not catch up
    tasks = [Slots(100.0, 1.0, i, 3) for i in range(3)]
    assert [x.next(100.0) for x in tasks] == [100, 101, 102]
    tasks[1].take()
    assert tasks[1].next(100.0) == 104 and tasks[0].next(110.5) == 112 and tasks[2].next(111.0) == 111 and tasks[2].next(111.9) == 111
    # the linear policy waits longer for rate-limit errors than for other errors
    lin = RetryPolicy()
    assert lin.delay(1, True) == 120 and lin.delay(1, False) == 5
    assert RetryPolicy(kind="exponential").delay(2, False) == 20


def test_top_k_windows_limit_before_shuffle(spark):
    from weft.plans.catalog import QUERIES

    plan = QUERIES["breaker_trips"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_distinct_items_are_asked_once(spark):
    from weft.plans.enrich import enrich_distinct

    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    n_distinct = d.select("text").distinct().count()
    acc = spark.sparkContext.accumulator(0)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=CountingBackend(acc), policy=NO_SLEEP)
    out = enrich_distinct(d, spec)
    assert out.count() == d.count() and acc.value == n_distinct < d.count()


def test_row_key_is_stable(spark):
    from weft.plans.enrich import with_row_key

    a = with_row_key(table(spark, SF_SMALL, "documents")).select("doc_id", "row_key").collect()
    b = with_row_key(table(spark, SF_SMALL, "documents")).select("doc_id", "row_key").collect()
    assert sorted(a) == sorted(b) and len({r.row_key for r in a}) == len(a)


def test_retry_after_is_honoured():
    import time as _t


    from weft.operators.inference import RateLimited, _run_batch

    class Once(Backend):
        def generate_one(self, prompt, items, attempt=0):
            if attempt == 0:
                raise RateLimited(retry_after=0.3)
            return "ok"

    t0 = _t.perf_counter()
    out = _run_batch(Once(), RetryPolicy(), ["p"], [None])
    assert out["text"][0] == "ok" and out["attempts"][0] == 2 and _t.perf_counter() - t0 >= 0.3


def test_final_report_rate(spark):
    from weft.operators import quality as QU

    stats = spark.createDataFrame([(10, 8, 1, 1)], "total long, processed long, remaining long, errors long")
    r = QU.final_report(stats, elapsed_s=7200).first()
    assert r.success_rate == 80.0 and r.elapsed_h == 2.0 and r.rows_per_hour == 4.0


def test_call_partitions_spreads_requests(spark):
    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP,
                      call_partitions=6, land=False)
    out = enrich(d, spec)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(6)" in plan
    assert out.count() == d.count()


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**12), min_size=1, max_size=60, unique=True), st.integers(1, 7),
       st.integers(1, 5), st.sampled_from(["hash", "div"]))
def test_pack_invariants_property(spark, keys, size, n_buckets, how):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = PK.pack(df, "k", size, n_buckets=n_buckets, bucket_fn=how).collect()
    assert sorted(r.k for r in rows) == sorted(keys)
    packs = {}
    for r in rows:
        packs.setdefault(r.batch_id, []).append(r.item_id)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= size for v in packs.values())
    # at most one short pack per bucket
    short = [b for b, v in packs.items() if len(v) < size]
    assert how == "div" or len(short) <= n_buckets


def test_breaker_streaks_with_a_hot_worker(spark):
    import random

    from weft.streaming.runlog import breaker_streaks

    rnd = random.Random(7)
    rows, i = [], 0
    for w, n in (("hot", 3000), ("a", 40), ("b", 25)):
        for k in range(n):
            rows.append((i, w, k, rnd.random() < 0.55))
            i += 1
    df = spark.createDataFrame(rows, "id long, worker string, t long, failed boolean")
    got = {r.worker: (r.max_streak, r.n_trips) for r in
           breaker_streaks(df, "worker", "t", F.col("failed"), "id", threshold=3, partitions=16).collect()}
    want = {}
    for w in ("hot", "a", "b"):
        seq = [f for (_, ww, _, f) in sorted(rows, key=lambda r: (r[1], r[2])) if ww == w]
        runs, cur = [], 0
        for f in seq + [False]:
            if f:
                cur += 1
            elif cur:
                runs.append(cur)
                cur = 0
        if runs:
            want[w] = (max(runs), sum(r >= 3 for r in runs))
    assert got == want


def test_job_end_to_end(spark, tmpdir_path):
    from weft.plans.job import EnrichJob, run

    src = os.path.join(tmpdir_path, "in.csv")
    docs(spark).write.options(header=True, quote='"', escape='"').csv(src)
    n = docs(spark).count()
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP, pack_size=5, n_buckets=4,
                      backend=FingerprintBackend(poison_item_prefixes="f"))
    job = EnrichJob(input_path=src + "/*.csv", output_path=os.path.join(tmpdir_path, "out"), spec=spec,
                    state_path=os.path.join(tmpdir_path, "state"), output_format="parquet")
    from weft.sources.readers import read_csv

    report = run(spark, job, df=read_csv(spark, src))
    assert report["total"] == n and report["processed"] == n and report["errors"] == 0 and report["keep_state"] is False
    out = spark.read.parquet(job.output_path)
    assert out.count() == n and out.filter(F.col("AI_RESULT").isNull()).count() == 0
    # a second run over the same state asks nothing, and its output is the whole table again
    acc = spark.sparkContext.accumulator(0)
    again = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP, backend=CountingBackend(acc))
    job2 = EnrichJob(input_path=src, output_path=os.path.join(tmpdir_path, "out2"), spec=again, state_path=job.state_path)
    assert run(spark, job2, df=read_csv(spark, src))["total"] == n and acc.value == 0
    columns = ["doc_id", "AI_RESULT"]
    assert sorted(spark.read.parquet(job2.output_path).select(columns).collect()) == sorted(out.select(columns).collect())


def test_job_tells_errors_by_status(spark, tmpdir_path):
    """Answers with words like error or timeout are answers; error rows are asked again by the next run."""

    from weft.plans.job import EnrichJob, run

    class Moody(Backend):
        def __init__(self, down):
            self.down = down

        def generate_one(self, prompt, items, attempt=0):
            if self.down and "two" in prompt:
                raise RuntimeError("HTTP 503")
            return "the answer explains a timeout error"

    df = spark.createDataFrame([(1, "one", ""), (2, "two", "Lỗi kết nối"), (3, "three", "done before"), (4, "  ", None)], "k long, text string, AI_RESULT string")
    state = os.path.join(tmpdir_path, "state")

    def go(down, name):
        acc = spark.sparkContext.accumulator(0)
        spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="k", policy=RetryPolicy(sleep=False, max_attempts=2), backend=Counting(Moody(down), acc))
        report = run(spark, EnrichJob("", os.path.join(tmpdir_path, name), spec, state_path=state, run_id=name), df=df)
        rows = {r["k"]: (r["result"]["status"], r["AI_RESULT"], r["result"]["error"]) for r in spark.read.parquet(os.path.join(tmpdir_path, name)).collect()}
        return report, rows, acc.value

    report, rows, calls = go(True, "first")
    assert (report["total"], report["processed"], report["errors"], report["remaining"], report["keep_state"]) == (4, 3, 1, 0, True)
    assert rows[1][:2] == ("OK", "the answer explains a timeout error") and rows[3][:2] == ("OK", "done before") and rows[4][0] == "NO_DATA"
    assert rows[2] == ("ERROR", "Retry failed: Lỗi xử lý sau 2 lần thử", "RuntimeError: HTTP 503")
    assert calls == 1 + 2 + 2
    report, rows, calls = go(False, "second")
    assert report["errors"] == 0 and report["total"] == 4 and calls == 1 and rows[2][0] == "OK" and len(rows) == 4


def test_keys_must_be_unique(spark, tmpdir_path):
    import pytest

    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="k", policy=NO_SLEEP, backend=FingerprintBackend())
    for keys in ((1, 1), (1, None)):
        df = spark.createDataFrame([(k, "t") for k in keys], "k long, text string")
        with pytest.raises(ValueError, match="unique"):
            INC.run_incremental(df, spec, os.path.join(tmpdir_path, "s"))


class Slow(Backend):
    """Answers after the seconds that a prompt names, and notes what was sent."""

    def __init__(self, max_concurrency=1):
        self.max_concurrency, self.sent = max_concurrency, []

    def generate_one(self, prompt, items, attempt=0):
        import time as _t

        self.sent.append(prompt)
        _t.sleep(float(prompt.split()[0]))
        return "ok"


def test_late_answers_are_taken_and_paid_for_once():
    """Calls outlast their time-out: each is sent once, two at a time, and its answer is kept."""
    import threading

    from weft.operators.inference import _run_batch

    class Wide(Slow):
        most = live = 0

        def generate_one(self, prompt, items, attempt=0):
            with lock:
                self.live += 1
                self.most = max(self.most, self.live)
            try:
                return super().generate_one(prompt, items, attempt)
            finally:
                with lock:
                    self.live -= 1

    lock, backend = threading.Lock(), Wide(2)
    out = _run_batch(backend, RetryPolicy(sleep=False, timeout_s=0.1, max_attempts=3), [f"0.35 {i}" for i in range(6)], [None] * 6)
    assert list(out["text"]) == ["ok"] * 6 and len(backend.sent) == 6 and backend.most == 2 and set(out["attempts"]) == {1}


def test_a_call_that_never_ends_is_given_up():
    from weft.operators.inference import _run_batch

    backend = Slow(2)
    policy = RetryPolicy(sleep=False, timeout_s=0.05, max_attempts=3, give_up_factor=4)
    out = _run_batch(backend, policy, ["1.5 a", "0.01 b", "0.01 c"], [None] * 3)
    assert list(out["text"]) == [None, "ok", "ok"] and "given up" in out["error"][0] and len(backend.sent) == 3
    ok = _run_batch(Slow(), policy, ["0.3"], [["a", "b"]])  # packs get twice the time
    assert ok["error"][0] is None and ok["attempts"][0] == 1


def test_backends_are_told_the_time_out():
    from weft.operators.backends import CallableBackend
    from weft.operators.inference import _opened, _run_batch

    def client(prompt, timeout):
        raise TimeoutError(f"ended after {timeout}s")

    policy = RetryPolicy(sleep=False, timeout_s=7, max_attempts=2)
    out = _run_batch(_opened(CallableBackend(client, pass_timeout=True), policy), policy, ["p"], [None])
    assert out["error"][0] == "TimeoutError: ended after 7s" and out["attempts"][0] == 2


def test_a_call_has_its_own_clock():
    """Slow calls cost only themselves: others are sent, answered and timed from their own start, once each."""
    from weft.operators.inference import _run_batch

    backend = Slow(3)
    prompts = ["0.8 a", "0.8 b", "0.02 c", "0.02 d", "0.02 e", "0.02 f"]
    out = _run_batch(backend, RetryPolicy(sleep=False, timeout_s=0.2, max_attempts=1), prompts, [None] * 6)
    assert list(out["text"]) == ["ok"] * 6 and sorted(backend.sent) == sorted(prompts)
    assert len(set(out["called_at"])) > 3 and all(10 <= ms < 200 for ms in out["latency_ms"][2:])


def test_one_limited_call_delays_no_other():
    import time as _t

    from weft.operators.inference import RateLimited, _run_batch

    class Limited(Backend):
        max_concurrency = 2

        def generate_one(self, prompt, items, attempt=0):
            if prompt == "limited" and attempt == 0:
                raise RateLimited(retry_after=0.4)
            return str(_t.time())

    t0 = _t.time()
    out = _run_batch(Limited(), RetryPolicy(), ["limited", "a", "b"], [None] * 3)
    assert all(float(x) - t0 < 0.3 for x in out["text"][1:]) and float(out["text"][0]) - t0 >= 0.4


def test_job_on_a_table_with_results(spark, tmpdir_path):
    from weft.plans.job import EnrichJob, run

    d = docs(spark).withColumn("AI_RESULT", F.when(F.col("doc_id") % 2 == 0, F.lit("kept answer")).otherwise(F.lit("")))
    acc = spark.sparkContext.accumulator(0)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP, backend=CountingBackend(acc))
    out_path = os.path.join(tmpdir_path, "o")
    rep = run(spark, EnrichJob(input_path="", output_path=out_path, spec=spec, retry_errors=False), df=d)
    n_pending = d.filter("AI_RESULT = ''").count()
    assert acc.value == n_pending and rep["total"] == d.count()
    out = spark.read.parquet(out_path)
    assert out.columns.count("AI_RESULT") == 1
    assert out.filter("AI_RESULT = 'kept answer'").count() == d.count() - n_pending


def test_stream_epoch_is_idempotent(spark, tmpdir_path):
    d = docs(spark)
    state = os.path.join(tmpdir_path, "state")
    acc = spark.sparkContext.accumulator(0)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=CountingBackend(acc), policy=NO_SLEEP)
    INC.save_state(enrich(d, spec), "doc_id", state, "epoch-0")
    calls = acc.value
    # a later run of the same key wins over an earlier one, by write time (not by the run id text)
    INC.save_state(enrich(d.limit(3), spec), "doc_id", state, "epoch-10")
    latest = INC.load_state(spark, state)
    assert latest.count() == d.count() and latest.filter("run_id = 'epoch-10'").count() == 3
    assert acc.value == calls + 3


def test_spec_validation():
    import pytest

    with pytest.raises(ValueError):
        EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), pack_format="xml")
    with pytest.raises(ValueError):
        EnrichSpec(prompt=PROMPT, columns="text", key="doc_id", backend=FingerprintBackend())
    with pytest.raises(ValueError):
        EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), pack_size=0)


def test_live_backends_get_prompts_only(spark):
    from weft.operators.backends import CallableBackend

    seen = spark.sparkContext.accumulator(0)
    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", pack_size=5, n_buckets=4, policy=NO_SLEEP,
                      backend=Counting(CallableBackend(lambda p: "\n".join(f"[{i}] ok" for i in range(1, 6)), max_concurrency=2), seen))
    out = enrich(d, spec)
    assert out.filter("result.status = 'OK'").count() == d.count()
    plan = pack_requests(d, spec)
    assert not spec.backend.needs_items and "_item_texts" in plan.columns


def test_request_log_feeds_the_audits(spark):
    from weft.operators import quality as QU
    from weft.streaming import runlog as RL

    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", pack_size=5, n_buckets=4, policy=NO_SLEEP,
                      backend=FingerprintBackend(poison_item_prefixes="0"))
    out = enrich(d, spec)
    log = QU.request_log(out)
    n_calls = pack_requests(d, spec).filter("_has").count()
    rows = log.collect()
    assert len(rows) == n_calls and {r.success for r in rows} == {True, False}
    assert all(r.retry_count == (2 if not r.success else 0) for r in rows)
    p = QU.progress(log, "called_at", F.col("success")).first()
    assert p.total == n_calls and 0 < p.processed < n_calls
    assert RL.rate_audit(log, "called_at", rpm=1000).agg(F.sum("n_requests")).first()[0] == n_calls
    single = enrich(d, EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP,
                                  backend=FingerprintBackend(dead_prefixes="0")))
    slog = QU.request_log(single).collect()
    assert len(slog) == d.count() and any(not r.success for r in slog)


def test_packs_with_json_mode(spark):
    import hashlib

    d = docs(spark)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", pack_size=5, n_buckets=4, pack_format="json",
                      use_json=True, policy=NO_SLEEP, backend=FingerprintBackend(response_format="json"))
    rows = enrich(d, spec).select("text", "result.status", "result.method", "AI_RESULT").collect()
    assert all(r.status == "OK" for r in rows)
    import re as _re
    sample = rows[0]
    cleaned = _re.sub(r"\n\n\n", "\n\n", sample.text.strip()).replace("\t", " ")
    # each item's answer object is not a five-field result: written back as compact JSON, key order kept
    assert sample.AI_RESULT == '{"answer":"' + hashlib.md5(cleaned.encode()).hexdigest() + '"}'


def dying(at):
    """A backend that ends its task at a prompt: that is no error of a call."""

    class Dying(Backend):
        def generate_one(self, prompt, items, attempt=0):
            if at in prompt:
                raise KeyboardInterrupt("Killed")
            return "answer"

    return Dying()


def test_a_killed_run_keeps_the_answers_of_its_finished_tasks(spark, tmpdir_path):
    import pytest

    from weft.plans.job import EnrichJob, run

    df = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(".")).alias("text")).repartition(1)
    state, out = os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "out")
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="k", policy=NO_SLEEP, backend=dying("row 399."))
    with pytest.raises(Exception):
        run(spark, EnrichJob("", out, spec, state_path=state, commit_rows=20), df=df)
    kept = INC.load_state(spark, state)
    kept = {int(r["row_key"]) for r in kept.collect()} if kept is not None else set()
    assert 0 < len(kept) < 400 and 399 not in kept
    acc = spark.sparkContext.accumulator(0)
    again = EnrichSpec(prompt=PROMPT, columns=("text",), key="k", policy=NO_SLEEP, backend=Counting(dying("never"), acc))
    report = run(spark, EnrichJob("", out, again, state_path=state), df=df)
    assert acc.value == 400 - len(kept) and report["processed"] == 400 and report["success_rate"] == 100
    from weft.plans.job import report_frame

    assert report_frame(spark.read.parquet(out)).first().asDict() == {k: v for k, v in report.items() if k != "keep_state"}
    with pytest.raises(FileExistsError):  # before anything is paid for
        run(spark, EnrichJob("", out, again, state_path=os.path.join(tmpdir_path, "other")), df=df)
    assert acc.value == 400 - len(kept)


def test_ledger_spares_calls_of_other_runs_and_tables(spark, tmpdir_path):
    from weft.plans.ledger import Ledger, enrich_with_ledger, unpaid
    from weft.plans.enrich import with_prompts

    ledger = Ledger(os.path.join(tmpdir_path, "ledger"), buckets=5)
    frame = lambda rows: spark.createDataFrame(rows, "k long, text string")

    def ask(rows, backend, key="k"):
        acc = spark.sparkContext.accumulator(0)
        spec = EnrichSpec(prompt=PROMPT, columns=("text",), key=key, policy=NO_SLEEP, backend=Counting(backend, acc))
        out = enrich_with_ledger(frame(rows), spec, ledger).collect()
        return {r["k"]: (r["result"]["status"], r["AI_RESULT"]) for r in out}, acc.value

    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, " ")] + [(100 + i, f"t{i}") for i in range(30)]
    first, calls = ask(rows, FingerprintBackend())
    assert calls == 32 and len(first) == 35 and first[4][0] == "NO_DATA" and first[1] == first[2]
    down = FingerprintBackend(dead_prefixes="0123456789abcdef")
    second, calls = ask([(k + 1000, t) for k, t in rows] + [(7, "new")], down)
    assert calls == 3 and second[7][0] == "ERROR" and all(second[k + 1000] == v for k, v in first.items())  # three attempts
    third, calls = ask([(7, "new")], FingerprintBackend())
    assert calls == 1 and third[7][0] == "OK"
    assert ask([(7, "new")], down)[1] == 0 and ask([], down) == ({}, 0)
    # the ledger is neither shuffled nor sorted to be looked up
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="k", backend=down)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = unpaid(with_prompts(frame(rows), spec), ledger)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan and plan.index("Exchange ") < plan.index("FileScan")


def test_one_rate_for_all_tasks(spark):
    rpm = 1200
    d = spark.range(60).select(F.col("id").alias("k"), F.col("id").cast("string").alias("text"), F.lit("x").alias("more"))
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="k", backend=FingerprintBackend(), policy=RetryPolicy(rpm=rpm))
    rows = enrich(d, spec).collect()
    starts = sorted(r["result"]["called_at"].timestamp() for r in rows)
    assert len(rows) == 60 and all(r["result"]["status"] == "OK" and r["more"] == "x" for r in rows)
    assert len({r["result"]["task"] for r in rows}) > 1
    assert starts[-1] - starts[0] >= 58 * 0.05 and max(sum(1 for x in starts if s <= x < s + 1) for s in starts) <= 21


def test_paced_calls_that_start_late_keep_their_slots():
    """Tasks that wake up to 5 ms late use the slots of 1 ms, and no 60 seconds see more than the rate and one call."""
    from bisect import bisect_left

    from weft.operators.inference import PACED_LATE_S, Slots

    rpm, tasks, seconds = 60_000, 12, 90
    starts = []
    for task in range(tasks):
        slots, now = Slots.of_rate(0.0, rpm, task, tasks), 0.0
        while now < seconds:
            begins = slots.next(now)
            if begins > now:
                now = begins + len(starts) % 6 * 0.001
                continue
            starts.append(now)
            slots.take()
    starts.sort()
    assert len(starts) >= 0.99 * rpm * seconds / 60
    assert max(bisect_left(starts, t + 60) - i for i, t in enumerate(starts)) <= rpm + 1
    # a task that was away for longer loses its slots but for those of the last PACED_LATE_S
    slots = Slots.of_rate(0.0, rpm, 0, 1)
    free = 0
    while slots.next(10.0) <= 10.0:
        slots.take()
        free += 1
    assert free <= PACED_LATE_S * rpm / 60 + 1
    # slow rates are as they were: a slot is an interval long
    assert Slots.of_rate(0.0, 1200).late == 0.05 and abs(Slots.of_rate(0.0, 1200).interval - 0.05) < 1e-9


def test_rate_audit_slides_over_minutes(spark):
    import datetime as dt

    from weft.streaming.runlog import rate_audit

    base = dt.datetime(2025, 1, 1)
    seconds = [0, 0, 30, 59.5, 61, 89.9, 90, 90, 300, 300.000001] + [600 + i * 0.01 for i in range(500)]
    log = spark.createDataFrame([(base + dt.timedelta(seconds=s),) for s in seconds], "ts timestamp").repartition(6)
    got = {int((r["minute"] - base).total_seconds()): r for r in rate_audit(log, "ts", rpm=3).collect()}
    for minute, r in got.items():
        mine = [s for s in seconds if minute <= s < minute + 60]
        assert r["n_requests"] == len(mine)
        assert r["worst_window"] == max(sum(1 for x in seconds if s <= x < s + 60) for s in mine)
        gaps = [b - a for a, b in zip(seconds, seconds[1:], strict=False) if minute <= b < minute + 60]
        assert abs((r["min_gap_s"] if r["min_gap_s"] is not None else -1) - min(gaps, default=-1)) < 1e-6
    assert got[0]["window_over_limit"] and not got[300]["window_over_limit"] and got[300]["too_close"]
    assert rate_audit(log.where("false"), "ts").count() == 0


# compacted state ------------------------------------------------------------------------------------------


def _state_rows(spark, rows):
    """State rows (key, answer, second of writing, run) as ``save_state`` lays them out."""
    from datetime import datetime, timedelta, timezone

    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    full = [(k, "OK", v, None, None, 1, v, at + timedelta(seconds=s), run) for k, v, s, run in rows]
    return spark.createDataFrame(full, INC.STATE_SCHEMA)


def _append(spark, path, rows):
    _state_rows(spark, rows).write.mode("append").partitionBy("run_id").parquet(path)


def _brute(rows):
    best = {}
    for k, v, s, run in rows:
        if k not in best or (s, run) > best[k][1:]:
            best[k] = (v, s, run)
    return {k: (v, run) for k, (v, s, run) in best.items()}


def test_compacted_state_equals_the_whole_log(spark, tmpdir_path):
    import random

    dice, path, rows = random.Random(5), f"{tmpdir_path}/state", []
    for turn in range(6):
        # run names that need escaping; keys that repeat, keys below the first slice, and write times that go back
        run = f"run {turn}/é:{turn}"
        new = [(f"{dice.choice(['k', 'a', 'zß'])}{k}", f"v{turn}-{k}", dice.randrange(1000), run) for k in dice.sample(range(300), 120)]
        new = list({k: (k, *rest) for k, *rest in new}.values())
        rows += new
        _append(spark, path, new)
        if turn % 2:
            INC.compact_state(spark, path, slice_rows=40)
        got = {r["row_key"]: (r["value"], r["run_id"]) for r in INC.load_state(spark, path).collect()}
        assert got == _brute(rows)
        status = INC.latest_status(spark, path)
        assert status.columns == ["row_key", "status"] and status.count() == len(got)


def test_compaction_writes_only_slices_with_new_rows(spark, tmpdir_path):
    from weft.streaming import generations as G

    names = lambda files: {f.rsplit("/", 1)[1] for f in files}
    path = f"{tmpdir_path}/state"
    _append(spark, path, [(f"{i:05d}", f"v{i}", 0, "1") for i in range(1000)])
    first = INC.compact_state(spark, path, slice_rows=100)
    assert len(first.slices) >= 8 and sum(s[2] for s in first.slices) == 1000
    lows = [s[1] for s in first.slices]
    assert lows == sorted(lows) and INC.compact_state(spark, path) == first  # nothing new: no generation
    # all covered: the slices are read as they lie, and the log is not read at all
    seen = INC.load_state(spark, path)
    assert "Exchange" not in seen._jdf.queryExecution().executedPlan().toString()
    assert names(seen.inputFiles()) == names(s[0] for s in first.slices)
    # a few keys in one slice: the others' files stay, and readers of the old snapshot are not disturbed
    _append(spark, path, [("00005", "new", 9, "2"), ("00007", "old", -9, "2")])
    reader = INC.load_state(spark, path)
    second = INC.compact_state(spark, path, slice_rows=100)
    assert len(set(first.slices) - set(second.slices)) == 1
    for state in (reader, INC.load_state(spark, path)):
        got = {r["row_key"]: r["value"] for r in state.collect()}
        assert len(got) == 1000 and got["00005"] == "new" and got["00007"] == "v7"
    # more slices than allowed: all keys are dealt anew
    _append(spark, path, [("x", "x", 1, "3")])
    third = G.compact(INC._read_state(spark, path), path, slice_rows=1, max_slices=4)
    assert not set(third.slices) & set(second.slices) and len(third.slices) <= 6
    assert INC.load_state(spark, path).count() == 1001


def test_compaction_that_breaks_off_changes_nothing(spark, tmpdir_path):
    path = f"{tmpdir_path}/state"
    assert INC.compact_state(spark, path) is None  # no state yet
    _append(spark, path, [("a", "1", 0, "1")])
    first = INC.compact_state(spark, path)
    _append(spark, path, [("a", "2", 1, "2")])
    # a generation whose manifest was never written: its files are there, and nobody reads them
    _state_rows(spark, [("a", "half", 5, "9"), ("b", "half", 5, "9")]).write.parquet(f"{path}-generations/data/generation=2-half/slice=0")
    got = INC.load_state(spark, path).collect()
    assert [(r["row_key"], r["value"]) for r in got] == [("a", "2")]
    second = INC.compact_state(spark, path)
    assert second.number == first.number + 1
    assert [(r["row_key"], r["value"], r["run_id"]) for r in INC.load_state(spark, path).collect()] == [("a", "2", "2")]


# failed rows under timers ---------------------------------------------------------------------------------


def test_failed_rows_wait_under_timers_and_are_asked_in_later_batches(spark, tmpdir_path):
    """The waits are kept, a row never gets more calls than allowed, and template columns and blanks reach the second call."""
    import time

    from weft.streaming.retries import retry_stream, stop_when_settled

    calls = f"{tmpdir_path}/calls"
    os.makedirs(calls)

    def flaky(prompt):
        with open(f"{calls}/{hashlib.md5(prompt.encode()).hexdigest()}", "a") as f:
            f.write(f"{time.time()}\n")
            seen = f.tell()
        if "never" in prompt or ("later" in prompt and seen < 40):
            raise RuntimeError("service unavailable")
        return prompt.upper()

    src, state = f"{tmpdir_path}/in", f"{tmpdir_path}/state"
    texts = ["fine", "later \"quoted\"\n{x}", "later b", "never", None, ""]
    docs = spark.createDataFrame([(i, t, f"T{i} {{input_text}}", True) for i, t in enumerate(texts)], "id int, text string, tpl string, needs boolean")
    docs.write.parquet(src)
    spec = EnrichSpec(prompt="p:", columns=("text",), key="id", backend=CallableBackend(flaky), template="tpl", requires_context="needs",
                      policy=RetryPolicy(max_attempts=1, kind="exponential", base_delay=3.0))
    INC.enrich_stream(spark, src, docs.schema, spec, state, f"{tmpdir_path}/c1", keep_asked=True).awaitTermination()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    again = retry_stream(spark, state, spec, f"{tmpdir_path}/c2", max_attempts=3, settings=("tpl", "needs"), trigger="3 seconds")
    assert stop_when_settled(again, spark, state, 3, timeout_s=120)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    got = {r["row_key"]: (r["status"], r["attempts"], r["ai_result"]) for r in INC.load_state(spark, state).collect()}
    assert len(got) == 6 and got["0"][:2] == ("OK", 1) and got["4"][0] == got["5"][0] == "NO_DATA"
    assert got["3"][:2] == ("ERROR", 3) and got["3"][2].startswith(fixed.RETRY_FAILED_PREFIX) and got["3"][2].count(fixed.RETRY_FAILED_PREFIX) == 1
    assert got["1"][:2] == got["2"][:2] == ("OK", 3) and "T1 LATER \"QUOTED\"" in got["1"][2]
    times = [[float(t) for t in open(f"{calls}/{f}").read().split()] for f in os.listdir(calls)]
    assert sorted(len(t) for t in times) == [1, 3, 3, 3]
    for t in times:
        assert len(t) == 1 or (t[1] - t[0] >= 2 and t[2] - t[1] >= 5)  # written_at is the batch's start: a little before the call


def test_retry_stream_asks_only_for_what_a_broken_batch_had_not_written(spark, tmpdir_path):
    state = f"{tmpdir_path}/state"
    from weft.streaming.retries import ask_due

    due = spark.createDataFrame([("a", '{"text":"x"}', "old", 1), ("b", '{"text":"y"}', "old", 1)], "row_key string, asked string, old string, attempts int")
    spec = EnrichSpec(prompt="p:", columns=("text",), key="id", backend=FingerprintBackend())
    INC.save_state(ask_due(due.where("row_key = 'a'"), spec), "row_key", state, "retry-n-0", F.lit(None).cast("string"))
    left = due.join(INC.read_run(spark, state, "retry-n-0").select("row_key"), "row_key", "left_anti")
    assert [r["row_key"] for r in left.collect()] == ["b"] and INC.read_run(spark, state, "retry-n-1") is None
    assert [(r["attempts"], r["status"]) for r in INC.load_state(spark, state).collect()] == [(2, "OK")]


# what a Python worker holds of the requests ----------------------------------------------------------------


def test_worker_holds_a_bounded_number_of_bytes_of_requests(spark):
    """Long texts: the batches are bounded in bytes, for rows and for packs alike, and a smaller limit of the session stays."""
    from weft.operators.inference import BATCH_BYTES, _Values, bound_batches, call_model

    def held(prompt):
        import pyarrow as pa

        return str(pa.total_allocated_bytes())

    docs = spark.range(0, 600, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(" x" * 50_000)).alias("prompt"))  # 60 MB
    for items in (None, F.array("prompt")):
        out = call_model(docs, CallableBackend(held, max_concurrency=1), "prompt", items, RetryPolicy(), "r")
        assert max(int(r[0]) for r in out.select("r.text").collect()) < 4 * BATCH_BYTES
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    bound_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before)
    import pyarrow as pa

    lazy = _Values(pa.array([["a", "b"], None]))
    assert len(lazy) == 2 and lazy[0] == ["a", "b"] and lazy[1] is None


def test_waiting_for_settled_rows_reads_no_texts_and_goes_on_while_rows_settle(spark, tmpdir_path):
    from pyspark.sql.types import StringType

    from weft.streaming.retries import stop_when_settled, unsettled

    state = f"{tmpdir_path}/state"
    log = [("a", "ERROR", 1, 1), ("a", "OK", 2, 2), ("b", "ERROR", 1, 1), ("b", "ERROR", 3, 2), ("c", "ERROR", 2, 1), ("d", "OK", 1, 1)]
    rows = spark.createDataFrame(log, "row_key string, status string, attempts int, t int")
    texts = {c: F.lit(None).cast(StringType()) for c in ("value", "error", "raw", "ai_result")}
    put = lambda df, run: df.select("row_key", "status", "attempts", F.timestamp_seconds("t").alias("written_at"), *[v.alias(c) for c, v in texts.items()]).write.parquet(f"{state}/run_id={run}")
    put(rows, "1")
    left = unsettled(spark, state, 3)
    assert [tuple(r) for r in left.collect()] == [("c", "ERROR", 2)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "ai_result" not in plan and "raw" not in plan.replace("Draw", "")

    class Query:
        """A stream whose row c settles after longer than the time-out, while others' calls go on."""

        isActive, status, looks, stopped = True, {"isTriggerActive": False}, 0, False

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

    class Stepping(Query):
        @property
        def isActive(self):
            self.looks += 1
            if self.looks == 2:
                put(spark.createDataFrame([("e", "ERROR", 1, 3)], rows.schema), "2")
            if self.looks == 4:
                put(spark.createDataFrame([("c", "OK", 3, 4), ("e", "ERROR", 3, 4)], rows.schema), "3")
            return True

    query = Stepping()
    assert stop_when_settled(query, spark, state, 3, timeout_s=30) and query.stopped
    put(spark.createDataFrame([("f", "ERROR", 1, 5)], rows.schema), "4")
    assert not stop_when_settled(Query(), spark, state, 3, timeout_s=1)
