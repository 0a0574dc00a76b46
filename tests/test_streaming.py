"""Streams give what batches give."""

from tapeloom.operators import bars
from tapeloom.sources import messages
from tapeloom.streaming import tape

H = 3_600_000


def quote(coin, ms, bid, ask):
    return (ms, f'{{"channel":"bbo","data":{{"coin":"{coin}","time":{ms},"bbo":[{{"px":"{bid}","sz":"2"}},{{"px":"{ask}","sz":"1"}}]}}}}')


def finished(rows, path, **options):
    q = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/out")


def test_quote_bars_of_a_stream(spark, tmp_path):
    made = [quote(c, i * 700_000, 100 + i, 101 + i) for i in range(30) for c in "ab"]
    spark.createDataFrame(made, tape.RAW).repartition(3).write.parquet(f"{tmp_path}/raw")
    stream = tape.stream_quote_bars(tape.channel_stream(tape.raw_stream(spark, f"{tmp_path}/raw"), "bbo"), "1 hour")
    finished(stream, tmp_path)
    spark.createDataFrame([quote("z", 100 * H, 1, 2)], tape.RAW).write.mode("append").parquet(f"{tmp_path}/raw")
    stream = tape.stream_quote_bars(tape.channel_stream(tape.raw_stream(spark, f"{tmp_path}/raw"), "bbo"), "1 hour")
    plain = lambda df: sorted((r["coin"], r["bar"], *(round(r[c], 9) for c in ("obi", "mid", "spread_bps"))) for r in df.collect())
    got = plain(finished(stream, tmp_path))
    batch = bars.quote_bars(messages.bbo(spark.createDataFrame(made, tape.RAW)), H, tie="bid_px")
    assert got == plain(batch) and len(got) > 10


def test_sink_partitions_by_event_hour(spark, tmp_path):
    made = [quote("dex:ABC", 5, 1, 2), quote("dex:ABC", H + 5, 1, 2)]
    spark.createDataFrame(made, tape.RAW).write.parquet(f"{tmp_path}/raw")
    rows = tape.channel_stream(tape.raw_stream(spark, f"{tmp_path}/raw"), "bbo")
    for _ in range(2):  # a second run adds nothing
        tape.sink(rows, "bbo", f"{tmp_path}/tape", f"{tmp_path}/check", {"availableNow": True}).awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/tape/bbo")
    assert sorted((str(r["dt"]), int(r["hr"])) for r in back.collect()) == [("1970-01-01", 0), ("1970-01-01", 1)]
    assert back.first()["coin"] == "dex:ABC"


def stalls(rows):
    return sorted((r["coin"], r["kind"], r["last_ms"], r["at_ms"]) for r in rows.collect())


def test_stalls_of_a_stream_out_of_order_and_restarted(spark, tmp_path):
    """One file a batch, rows out of order within the delay, a restart between batches: as the table of all rows has it."""
    from tapeloom.streaming import alerts

    minute = 60_000
    feeds = {"a": [0, 1, 2, 9, 10, 11, 30, 31, 60, 61, 62], "b": list(range(0, 61, 3)), "c": [5, 9], "d": [0, 4, 8, 11]}
    began = 1000 * minute  # rows at the time 0 are behind any watermark
    rows = sorted((began + m * minute, c) for c, ms in feeds.items() for m in ms)
    batches = [[r for r in rows if lo <= r[0] - began < lo + 10 * minute] for lo in range(0, 70 * minute, 10 * minute)]
    # Each batch gives some of its rows to the next one: they come late, within the delay.
    late = [[r for i, r in enumerate(b) if i % 3 == 1] for b in batches]
    files = [[*(r for r in b if r not in late[k]), *(late[k - 1] if k else [])][::-1] for k, b in enumerate(batches)]
    files += [late[-1], [(3000 * minute, "end")], [(3000 * minute, "end")]]
    schema, path = "captured_ms bigint, coin string", f"{tmp_path}/rows"

    def stream():
        return alerts.stall_alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["coin"], delay="25 minutes").filter("coin <> 'end'")

    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(path)
        got = finished(stream(), tmp_path)  # a run of its own: state and timers come from the checkpoint
    table = spark.createDataFrame(rows, schema).repartition(3)
    want = stalls(alerts.stall_table(table, ["coin"], 3000 * minute))
    assert stalls(got) == want and len(want) > 12
    kinds = [(k, last // minute - 1000, at // minute - 1000) for c, k, last, at in want if c == "a"]
    assert kinds == [("recovered", 2, 9), ("recovered", 11, 30), ("recovered", 31, 60), ("stall", 2, 6), ("stall", 11, 15), ("stall", 31, 35), ("stall", 62, 66)]


def test_state_of_a_feed_grows_with_gaps_only():
    from tapeloom.streaming import alerts

    lo, hi = alerts.merged([], [], list(range(0, 100_000, 7)), 60)
    assert (lo, hi) == ([0], [99_995])
    lo, hi = alerts.merged(lo, hi, [200_000, 100_054, 100_055], 60)
    assert (lo, hi) == ([0, 200_000], [100_055, 200_000])
    said, stalled, lo, hi = alerts.decided(False, lo, hi, 150_000, 60)
    assert said == [("stall", 100_055, 100_115)] and stalled and lo == [0, 200_000]


def messages_of_all_channels(k):
    """Three messages of each channel, of batch ``k``."""
    rows = []
    for i in range(3):
        ms = k * H + i
        rows += [
            quote("a", ms, 1, 2), (ms, f'{{"channel":"trades","data":[{{"coin":"b","side":"B","px":"2","sz":"3","time":{ms},"tid":{ms},"hash":"h","users":["u","v"]}}]}}'),
            (ms, f'{{"channel":"activeAssetCtx","data":{{"coin":"dex:C","ctx":{{"funding":"{i}"}}}}}}'), (ms, f'{{"channel":"l2Book","data":{{"coin":"d","time":{ms},"levels":[[],[{{"px":"5","sz":"1"}}]]}}}}'), (ms, "no json")]
    return rows


def test_fan_out_restarts_between_two_sinks_without_doubles(spark, tmp_path, monkeypatch):
    from tapeloom.streaming import fan

    path, root, check = (f"{tmp_path}/{x}" for x in ("raw", "tape", "check"))
    whole, failed = fan.write_channel, []

    def breaking(rows, channel, root, number, by):
        """The job ends in its second batch, once two of the four sinks are done."""
        if number == 1 and channel == "bbo" and not failed:
            failed.append(number)
            raise RuntimeError("the job ends here")
        whole(rows, channel, root, number, by)

    monkeypatch.setattr(fan, "write_channel", breaking)
    sizes, seen = [], []
    for k in range(4):
        spark.createDataFrame(messages_of_all_channels(k), tape.RAW).coalesce(1).write.mode("append").parquet(path)
        q = fan.fan_out(tape.raw_stream(spark, path, 1), root, check, trigger={"availableNow": True})
        try:
            q.awaitTermination()
        except Exception:
            seen.append(k)
            # The first two sinks have the second batch; readers do not see it.
            assert len(list((tmp_path / "tape").glob("*/batch=1"))) == 2
        sizes.append({c: fan.load_channel(spark, root, c).count() for c in messages.NORMALISERS})
    assert seen == [1] and failed == [1]
    # A batch of messages for each run, but that the third one makes up for the second.
    assert sizes == [dict.fromkeys(messages.NORMALISERS, 3 * n) for n in (1, 1, 3, 4)]
    assert sum(r["rows"] for r in fan.finished(spark, root).collect()) == 60
    trades = fan.load_channel(spark, root, "trades")
    assert trades.select("tid").distinct().count() == 12 and {(r["dt"], r["hr"]) for r in trades.collect()} == {("1970-01-01", f"{k:02}") for k in range(4)}
    ctx = fan.load_channel(spark, root, "ctx")
    assert {r["coin"] for r in ctx.collect()} == {"dex:C"} and ctx.columns[-2:] == ["dt", "hr"]


def test_fan_out_keeps_known_coins(spark, tmp_path):
    from tapeloom.streaming import fan

    fan.write_batch(spark.createDataFrame(messages_of_all_channels(0), tape.RAW), 0, str(tmp_path), ["a", "d"])
    assert {c: fan.load_channel(spark, str(tmp_path), c).count() for c in messages.NORMALISERS} == {"trades": 0, "l2book": 3, "bbo": 3, "ctx": 0}


def test_fan_batches_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from tapeloom.streaming import fan, plans

    monkeypatch.setattr(plans, "scratch", lambda s, tag: f"{tmp_path}/{tag}")
    monkeypatch.setattr(plans, "FILE_MESSAGES", 7, raising=False)
    monkeypatch.setattr(plans, "BATCH_FILES", 3, raising=False)
    made = spark.createDataFrame([m for k in range(20) for m in messages_of_all_channels(k)], tape.RAW).coalesce(2)
    assert plans.fanned(spark, made, "trades").count() == 60
    sizes = [r["rows"] for r in fan.finished(spark, f"{tmp_path}/fan/tape").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 21


def test_fan_splits_a_large_folder_over_tasks(spark, tmp_path):
    """All rows of a coin and day: one task held them, however many there were."""
    from pyspark.sql import functions as F

    from tapeloom.streaming import fan

    ms = F.col("id").cast("string")
    levels = F.lit(',"levels":[[],[{"px":"5","sz":"1"}]]}}')
    raw = spark.range(20_000).select(F.col("id").alias("captured_ms"), F.concat(F.lit('{"channel":"l2Book","data":{"coin":"d","time":'), ms, levels).alias("value"))
    books = messages.l2book(raw).withColumn("levels_json", F.sha2(F.col("book_ms").cast("string"), 512))  # does not compress
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100k")
    try:
        fan.write_channel(books, "l2book", str(tmp_path), 0, ("coin", "dt"))
    finally:
        spark.conf.set(size, before)
    files = list((tmp_path / "l2book" / "batch=0" / "coin=d" / "dt=1970-01-01").glob("part-*"))
    assert len(files) > 2 and spark.read.parquet(f"{tmp_path}/l2book").count() == 20_000


def test_fan_tables_are_read_after_a_tape(spark, tmp_path):
    """A tape read before, in the same session, leaves the channel's schema alone; the hour is in the files here, not in the folders."""
    from tapeloom import schemas
    from tapeloom.sources import layers
    from tapeloom.streaming import fan

    before = {c: list(kind.names) for c, kind in schemas.CHANNELS.items()}
    made = spark.createDataFrame(messages_of_all_channels(1), tape.RAW)
    layers.write_tape(messages.bbo(made), f"{tmp_path}/tape", "bbo")
    for _ in range(2):
        assert layers.load_tape(spark, f"{tmp_path}/tape", "bbo").columns.count("hr") == 1
    assert {c: list(kind.names) for c, kind in schemas.CHANNELS.items()} == before
    fan.write_batch(made, 0, f"{tmp_path}/fan", by=("coin", "dt"))
    assert [(r["coin"], r["hr"]) for r in fan.load_channel(spark, f"{tmp_path}/fan", "bbo").collect()] == [("a", "01")] * 3
