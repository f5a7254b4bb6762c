"""Keyed live jobs on typed state: streaks, sessions, one-time codes, newest alerts.

State lives in the embedded key-value store of the executors and is checkpointed with the query. Each processor keeps a
bounded or expiring amount per key, and says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import escalation, streaks

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 10_000
#: Times in JSON text keep their microseconds.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def typed_state(spark: SparkSession) -> None:
    """Typed state needs the key-value store; other stateful queries run on it as well."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def _rows(columns: dict) -> pd.DataFrame:
    """A frame whose texts are plain objects, which every Arrow conversion takes."""
    frame = pd.DataFrame(columns)
    return frame.astype({c: object for c in frame if pd.api.types.is_string_dtype(frame[c].dtype)})


# -- streaks ----------------------------------------------------------------

class _Streaks(StatefulProcessor):
    """State: current streak, longest streak and last day of a user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("streak", "streak int, longest int, last int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.now.update((int(row["streak"]), int(row["longest"]), int(row["last"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = set()
        for frame in rows:
            days.update(int(d) for d in frame["day"])
        streak, longest, last = self.now.get() if self.now.exists() else (0, 0, None)
        out = []
        for day in sorted(days):
            if last is not None and day <= last:
                continue
            streak = streak + 1 if last is not None and day == last + 1 else 1
            longest, last = max(longest, streak), day
            out.append((key[0], day, streak, longest))
        if out:
            self.now.update((streak, longest, last))
            yield _rows(dict(zip(("user_id", "day", "streak", "longest_streak"), zip(*out))))


def _drop_repeats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated rows of one Arrow batch add nothing and are not shuffled."""
    for frame in frames:
        yield frame.drop_duplicates()


def streak_history(days: DataFrame) -> DataFrame:
    """The state that past days (user_id, day) of every user lead to: user_id, streak, longest, last."""
    runs = streaks.streak_islands(days).groupBy("user_id").agg(
        F.max(F.struct("last_day", "length")).alias("run"), F.max("length").alias("longest"))
    return runs.select("user_id", F.col("run.length").cast("int").alias("streak"), F.col("longest").cast("int").alias("longest"),
                       F.unix_date("run.last_day").alias("last"))


def stream_streaks(checkins: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Running and longest streak of a user on every new check-in day.

    ``history`` (user_id, day) are days that are stored already: a new stream
    goes on from the streaks they end in, without reading them again. A day at
    or before the last one changes nothing. State is three numbers per user and
    a micro-batch holds only the distinct days of a user, however often the
    user checked in.
    """
    typed_state(checkins.sparkSession)
    days = checkins.select("user_id", F.unix_date(F.to_date("ts")).alias("day")).where(F.col("day").isNotNull())
    days = days.mapInPandas(_drop_repeats, days.schema)
    kind = days.schema["user_id"].dataType.simpleString()
    start = None if history is None else streak_history(history).groupBy("user_id")
    return days.groupBy("user_id").transformWithStateInPandas(
        _Streaks(), f"user_id {kind}, day int, streak int, longest_streak int", "append", "none", start)


# -- sessions ---------------------------------------------------------------

class _Sessions(StatefulProcessor):
    """State: the start of an open session; before it is known, the ids and times of early messages."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "start_us long")
        self.early = handle.getListState("early", "message_id string, ts_us long")

    def _verdicts(self, session, start, ids, times) -> pd.DataFrame:
        age = pd.Series(times, dtype="int64") - (start or 0)
        accepted = (age >= 0) & (age <= self.ttl) if start is not None else age < age
        return _rows({"session_id": session, "message_id": list(ids), "ts_us": list(times), "accepted": accepted.to_numpy()})

    def _waiting(self) -> Iterator[list[tuple]]:
        part = []
        for row in self.early.get() if self.early.exists() else ():
            part.append(tuple(row))
            if len(part) == CHUNK:
                yield part
                part = []
        if part:
            yield part

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else None
        known, soonest = start is not None, None
        for frame in rows:
            opened = frame.loc[frame["is_start"], "ts_us"]
            if start is None and len(opened):
                start = int(opened.min())
                self.start.update((start,))
                self.handle.registerTimer((start + self.ttl) // 1000 + 1)
            own = frame[~frame["copy"]]
            if not len(own):  # copies of a start only
                continue
            if start is not None:
                yield self._verdicts(key[0], start, own["message_id"], own["ts_us"])
            else:
                self.early.appendList(list(zip(own["message_id"], own["ts_us"].astype(int))))
                soonest = min(int(own["ts_us"].min()), soonest if soonest is not None else int(own["ts_us"].min()))
        if start is not None and not known:
            for part in self._waiting():
                yield self._verdicts(key[0], start, *zip(*part))
            self.early.clear()
        elif soonest is not None:
            self.handle.registerTimer(soonest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.start.exists():
            if self.start.get()[0] + self.ttl < now:
                self.start.clear()
            return
        stay, gone = [], []
        for part in self._waiting():
            for row in part:
                (gone if row[1] < now else stay).append(row)
        if gone:  # a start at or before these can no longer come
            self.early.clear()
            if stay:
                self.early.put(stay)
                self.handle.registerTimer(min(t for _, t in stay) // 1000 + 1)
            yield self._verdicts(key[0], None, *zip(*gone))


def stream_sessions(messages: DataFrame, ttl_seconds: int = 1800, lateness: str = "10 minutes", salts: int = 1) -> DataFrame:
    """Every message with the verdict whether its session was still open.

    ``messages`` has (session_id, message_id, ts, is_start). A session lives for
    a fixed time from its start, regardless of activity. Messages that come
    before the start of their session wait: a start in a later micro-batch
    accepts them, and when the watermark has passed them, so that no such start
    can come, they are refused. State is one start per open session, which an
    event-time timer removes, and the ids and times of waiting messages; texts
    never enter it.

    A session is one group; its messages pass through in Arrow batches. Where
    single sessions hold a large share of all messages, ``salts`` deals these
    over so many groups and copies each start to them.
    """
    typed_state(messages.sparkSession)
    kind = messages.schema["message_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("message_id"), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    rows = messages.withWatermark("ts", lateness).select(
        "session_id", F.col("message_id").cast("string").alias("message_id"), "ts", F.unix_micros("ts").alias("ts_us"), "is_start",
        own.alias("own"), *([F.explode(F.when(F.col("is_start"), every).otherwise(F.array(own))).alias("salt")] if salts > 1 else [own.alias("salt")]))
    rows = rows.withColumn("copy", F.col("salt") != F.col("own")).drop("own")
    types = rows.schema["session_id"].dataType.simpleString()
    out = rows.groupBy("session_id", "salt").transformWithStateInPandas(
        _Sessions(ttl_seconds * 1_000_000), f"session_id {types}, message_id string, ts_us long, accepted boolean", "append", "eventTime")
    return out.withColumn("message_id", F.col("message_id").cast(kind))


# -- one-time codes ---------------------------------------------------------

class _Codes(StatefulProcessor):
    """State: the code issued last for a key, which expires by itself."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.code = handle.getValueState("code", "code string, issued_us long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        issued, used = None, []
        for frame in rows:
            new = frame[frame["issued"]]
            for at, code in zip(new["at_us"], new["code"]):
                issued = max((int(at), code), issued or (int(at), code))
            used.append(frame.loc[~frame["issued"], ["use_id", "code"]])
        if issued:
            self.code.update((issued[1], issued[0]))
        held = self.code.get()[0] if self.code.exists() else None
        for frame in filter(len, used):
            yield _rows({"key": key[0], "use_id": frame["use_id"], "accepted": frame["code"] == held})


def stream_codes(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Whether a code that is entered is the one issued last for its key and still alive.

    ``requests`` has (key, use_id, at, code, issued): rows that issue a code
    and rows that enter one. Codes issued in a micro-batch count for the entries
    in it. State is one code per key with a time to live, so a pending sign-up
    or code is gone after that time without a sweep.
    """
    typed_state(requests.sparkSession)
    rows = requests.select("key", F.col("use_id").cast("long").alias("use_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"),
                           F.col("code").cast("string").alias("code"), "issued")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(
        _Codes(ttl_seconds * 1000), f"key {kind}, use_id long, accepted boolean", "append", "processingTime")


# -- newest alerts ----------------------------------------------------------

def _newest(frame: pd.DataFrame, key: str, n: int) -> pd.DataFrame:
    return frame.sort_values(["at_us", "assessment_id"], ascending=False).groupby(key, sort=False).head(n)


class _Newest(StatefulProcessor):
    """State: the newest n alerts of a doctor, and how often they have changed."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("newest", "at_us long, assessment_id long, alert string")
        self.changes = handle.getValueState("changes", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        best = pd.DataFrame(old, columns=["at_us", "assessment_id", "alert"])
        for frame in rows:
            both = frame[best.columns] if best.empty else pd.concat([best, frame[best.columns]])
            best = _newest(both.drop_duplicates("assessment_id").assign(one=0), "one", self.n)[best.columns]
        new = [(int(a), int(b), c) for a, b, c in best.itertuples(index=False)]
        if new == old:
            return
        self.held.put(new)
        change = (self.changes.get()[0] if self.changes.exists() else 0) + 1
        self.changes.update((change,))
        yield _rows({"doctor_id": key[0], "change": change, "rank": range(1, len(new) + 1), "alert": [r[2] for r in new]})


def stream_doctor_alerts(assessments: DataFrame, assignments: DataFrame, n: int = 50) -> DataFrame:
    """J2 live: the newest ``n`` flagged assessments of each doctor, written anew whenever they change.

    A stream-static join finds the doctors; each Arrow batch is cut to the
    newest n of a patient before it and of a doctor after it, so a crowded
    patient or doctor sends few rows. ``alert`` is the row as JSON. State is n
    alerts per doctor.
    """
    typed_state(assessments.sparkSession)
    flagged = escalation.flagged(assessments)
    rows = flagged.select("user_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at_us"), F.col("assessment_id").cast("long").alias("assessment_id"),
                          F.to_json(F.struct(*flagged.columns), TIMES).alias("alert"))

    def cut(key):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield _newest(frame, key, n)
        return run
    rows = rows.mapInPandas(cut("user_id"), rows.schema)
    care = assignments.select("doctor_id", "user_id").distinct()
    joined = rows.join(care, "user_id").select("doctor_id", "at_us", "assessment_id", "alert")
    joined = joined.mapInPandas(cut("doctor_id"), joined.schema)
    kind = joined.schema["doctor_id"].dataType.simpleString()
    return joined.groupBy("doctor_id").transformWithStateInPandas(
        _Newest(n), f"doctor_id {kind}, change long, rank int, alert string", "append", "none")


def current_alerts(log: DataFrame, schema) -> DataFrame:
    """doctor_id, rank and the columns of ``schema`` of the alerts that ``stream_doctor_alerts`` wrote last."""
    last = log.groupBy("doctor_id").agg(F.max("change").alias("change"))
    return log.join(last, ["doctor_id", "change"]).select("doctor_id", "rank", F.from_json("alert", schema, TIMES).alias("a")).select(
        "doctor_id", "rank", "a.*")
