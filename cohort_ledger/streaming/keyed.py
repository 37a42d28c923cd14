"""The QC log as a stream with keyed state.

Two stateful operators follow each other.  The first is keyed by event id: it
learns which entity an id belongs to and keeps a resolution that arrives before
its event.  The second is keyed by entity and holds the entity's timeline, the
opening and closing steps in the order of the log, in pages of ``PAGE`` steps.
Each page knows the state in which it is entered: the open event of each kind
and its last close by key.  New steps are put into their page; pages are run
again from there only until a page is left in the state in which the next one
is entered already.  What changes in the events is emitted.

Ids and entities are dealt over ``BUCKETS`` hashed groups, and a group's state is
one compressed value with a line for each, read and written once a batch; the second and
further pages of a long timeline stand beside it.  So a batch costs its own
lines, the pages that they change and the groups that they meet, in whatever
order lines come, and few calls of the state store.  The number of groups
belongs to the checkpoint.

The events are read from the appended changes by the latest version of each.

Defined results: the log's order is ``seq``, then time, then a hash of the line;
lines without ``seq`` come after all others.  A line that is delivered again
changes nothing.  Lines without a level or entity are left out, except a
resolution by id.  Ids must not be shared by events of several entities.
"""

from __future__ import annotations

import json
import sys
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from cohort_ledger.functions.qc import event_id
from cohort_ledger.model import DEFAULT_SCHEMA, EVENT_COLUMNS, LOG_SCHEMA, CohortSchema
from cohort_ledger.operators.replay import log_entries

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = 256
BUCKETS = 1 << 14

_FIELDS = ["seq", "at", "tie", "op", "kind", "opened", "by", "reason", "qc_event_id", "source", "transaction_id", "withdrawal_date"]
_STEP = "level string, entity_id string, seq long, at string, tie long, op string, kind string, opened long, by string, reason string, qc_event_id string, source string, transaction_id string, withdrawal_date string"
_CHANGE = (
    "level string, entity_id string, kind string, seq long, at string, tie long, deleted boolean, qc_event_id string, reason string, source string, "
    "created_by string, resolved_at string, resolved_by string, resolved_reason string, transaction_id string, withdrawal_date string"
)


def _step(row: Row) -> list:
    fields = row.asDict()
    return [fields[c] for c in _FIELDS]


def _order(step: list) -> tuple:
    """The place of a step in the log; the kind and operation part the steps of one line."""
    seq, at, tie, op, kind = step[:5]
    return (seq is None, seq or 0, at or "", tie, kind or "", op)


def _packed(text: str) -> bytes:
    """State as it is kept: every version of it is written whole, and its lines are much alike."""
    return zlib.compress(text.encode(), 3)


def _unpacked(state: bytes) -> str:
    return zlib.decompress(state).decode()


def _lines(held) -> dict[str, list[str]]:
    """The fields of each line of a group's state, by the first, which names it."""
    text = _unpacked(held.get()[0]) if held.exists() else ""
    return {name: fields for name, *fields in (line.split("\t") for line in text.split("\n") if line)}


def _keep(held, lines: dict[str, list[str]]) -> None:
    """Fields are JSON, so they hold neither tabs nor line ends."""
    held.update((_packed("\n".join("\t".join([name, *fields]) for name, fields in lines.items())),))


class ByEventId(StatefulProcessor):
    """Resolutions by id, as closing steps of the entity whose event has that id.

    Only the first resolution after the event's opening counts as one by id.  One
    before it closes by its own key, if it has any.  What an arrival changes is
    taken back by a step with operation ``gone`` at the same place.  Of an opening
    only its place and entity matter here.
    """

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[str, list[Row]] = {}
        for row in rows:
            arrived.setdefault(json.dumps(row.qc_event_id), []).append(row)
        lines = _lines(self.known)
        for name, of_id in arrived.items():
            state = json.loads(lines[name][0]) if name in lines else {"opened": None, "closes": []}
            yield from self._arrive(state, of_id)
            lines[name] = [json.dumps(state)]
        _keep(self.known, lines)

    def _arrive(self, state: dict, rows: list[Row]) -> Iterator[Row]:
        before = self._steps(state)
        for row in rows:
            step = _step(row)
            where = [row.level, row.entity_id, row.kind]
            if row.op == "open":
                if state["opened"] is None or _order(step) < _order(state["opened"][0]):
                    state["opened"] = [step, where]
            elif [step, where] not in state["closes"]:
                state["closes"].append([step, where])
        after = self._steps(state)
        for place, (level, entity, step) in before.items():
            if after.get(place) != (level, entity, step):
                yield self._row(level, entity, [*step[:3], "gone", *step[4:]])
        for place, (level, entity, step) in after.items():
            if before.get(place) != (level, entity, step):
                yield self._row(level, entity, step)

    @staticmethod
    def _steps(state: dict) -> dict:
        out, done = {}, False
        opened = state["opened"]
        for step, (level, entity, _) in sorted(state["closes"], key=lambda c: _order(c[0])):
            if opened is not None and _order(opened[0]) < _order(step):
                if done:
                    continue
                done = True
                level, entity, kind = opened[1]
                step = [*step[:4], kind, opened[0][0], *step[6:]]
            if level is not None and entity is not None:
                out[(level, entity, *_order(step))] = (level, entity, step)
        return out

    @staticmethod
    def _row(level: str, entity: str, step: list) -> Row:
        return Row(level=level, entity_id=entity, **dict(zip(_FIELDS, step, strict=True)))

    def close(self) -> None:
        pass


def walk(steps: list[list], entered: dict) -> tuple[dict, dict]:
    """(state after the steps, events) of a stretch of a timeline.

    The state has, for each kind, the open step and the ``seq`` of the last close
    by key.  The events are those open at the start and those opened in the
    stretch: the opening step and the closing one, or None, by their place.
    """
    state = {k: list(v) for k, v in entered.items()}
    events = {_order(s): [s, None] for s, _ in state.values() if s is not None}
    for step in steps:
        op, kind, opened = step[3], step[4], step[5]
        for k in list(state) if op == "close_all" else [kind or ""]:
            current, last = state.setdefault(k, [None, None])
            if op == "open":
                if current is None:
                    state[k] = [step, last]
                    events[_order(step)] = [step, None]
                continue
            if opened is not None and last is not None and last > opened:
                continue  # the event it names was closed by key before
            if current is not None:
                events[_order(current)][1] = step
            state[k] = [None, last if opened is not None else step[0]]
    return {k: v for k, v in state.items() if v != [None, None]}, events


class ByEntity(StatefulProcessor):
    """The timeline of an entity, in pages; emits the events that change."""

    def __init__(self, page: int = PAGE):
        self.page = page

    def init(self, handle) -> None:
        self.index = handle.getValueState("index", "pages string")
        self.pages = handle.getMapState("pages", "page long", "steps string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # For each page its name, the place of its first step and the state in which it is entered.
        index = json.loads(self.index.get()[0]) if self.index.exists() else [[0, None, {}]]
        arrived: dict[int, list] = {}
        firsts = [tuple(p[1]) if p[1] else () for p in index]
        for row in rows:
            step = _step(row)
            at = max(bisect_right(firsts, _order(step)) - 1, 0)
            arrived.setdefault(at, []).append(step)
        if not arrived:
            return
        old: dict = {}
        new: dict = {}
        out, at, state = [], min(arrived), index[min(arrived)][2]
        while at < len(index):
            name, _, entered = index[at]
            if at not in arrived and state == entered and at > min(arrived):
                later = [a for a in arrived if a > at]
                if not later:
                    break
                out += index[at : min(later)]
                at = min(later)
                state = index[at][2]
                continue
            steps = json.loads(self.pages.getValue((name,))[0]) if self.pages.containsKey((name,)) else []
            _, was = walk(steps, entered)
            self._put(was, old)
            steps = self._merged(steps, arrived.get(at, []))
            for first in range(0, max(len(steps), 1), self.page):
                part = steps[first : first + self.page]
                after, events = walk(part, state)
                self._put(events, new)
                page = name if first == 0 else max(p[0] for p in [*index, *out]) + 1
                out.append([page, list(_order(part[0])) if part else None, state])
                if at in arrived or first:
                    self.pages.updateValue((page,), (json.dumps(part),))
                state = after
            at += 1
        kept = index[: min(arrived)]
        rest = index[at:]
        self.index.update((json.dumps(kept + out + rest),))
        level, entity = key
        for place, pair in new.items():
            if old.get(place) != pair:
                yield self._change(level, entity, pair, False)
        for place, pair in old.items():
            if place not in new:
                yield self._change(level, entity, pair, True)

    @staticmethod
    def _put(events: dict, into: dict) -> None:
        """Events of a later page over those of an earlier one, which may not have seen the close."""
        for place, (opened, closed) in events.items():
            if closed is not None or place not in into:
                into[place] = [opened, closed]

    @staticmethod
    def _merged(steps: list[list], arrived: list[list]) -> list[list]:
        places = [_order(s) for s in steps]
        for step in sorted(arrived, key=lambda s: (_order(s), s[3] != "gone")):
            if step[3] == "gone":  # takes back a close by id or by key
                place = _order([*step[:3], "close", *step[4:]])
                at = bisect_left(places, place)
                if at < len(places) and places[at] == place and steps[at][5] == step[5]:
                    del places[at], steps[at]
                continue
            at = bisect_left(places, _order(step))
            if at < len(places) and places[at] == _order(step):
                steps[at] = step
            else:
                places.insert(at, _order(step))
                steps.insert(at, step)
        return steps

    @staticmethod
    def _change(level: str, entity: str, pair: list, deleted: bool) -> Row:
        opened = dict(zip(_FIELDS, pair[0], strict=True))
        closed = dict(zip(_FIELDS, pair[1], strict=True)) if pair[1] else {}
        return Row(
            level=level, entity_id=entity, kind=opened["kind"], seq=opened["seq"], at=opened["at"], tie=opened["tie"], deleted=deleted, qc_event_id=opened["qc_event_id"],
            reason=opened["reason"], source=opened["source"], created_by=opened["by"], resolved_at=closed.get("at"), resolved_by=closed.get("by"),
            resolved_reason=closed.get("reason"), transaction_id=opened["transaction_id"], withdrawal_date=opened["withdrawal_date"],
        )

    def close(self) -> None:
        pass


class _Index:
    """The index of an entity, out of its line."""

    def __init__(self, text: str | None):
        self.text = text

    def exists(self) -> bool:
        return self.text is not None

    def get(self) -> tuple:
        return (self.text,)

    def update(self, value: tuple) -> None:
        (self.text,) = value


class _Pages:
    """The pages of an entity: page 0 stands in its line, the others in the map."""

    def __init__(self, first: str | None, others, name: str):
        self.first, self.others, self.name = first, others, name

    def _at(self, page: int) -> tuple:
        return (f"{self.name} {page}",)

    def containsKey(self, key: tuple) -> bool:
        return self.first is not None if key[0] == 0 else self.others.containsKey(self._at(*key))

    def getValue(self, key: tuple) -> tuple:
        return (self.first,) if key[0] == 0 else (_unpacked(self.others.getValue(self._at(*key))[0]),)

    def updateValue(self, key: tuple, value: tuple) -> None:
        if key[0] == 0:
            (self.first,) = value
        else:
            self.others.updateValue(self._at(*key), (_packed(value[0]),))


class EntityGroup(ByEntity):
    """The timelines of a group of entities, each as ``ByEntity`` keeps it."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "state binary")
        self.others = handle.getMapState("pages", "page string", "steps binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[tuple, list[Row]] = {}
        for row in rows:
            arrived.setdefault((row.level, row.entity_id), []).append(row)
        lines = _lines(self.known)
        for entity, of_entity in arrived.items():
            name = json.dumps(entity)
            index, first = lines.get(name, (None, None))
            self.index, self.pages = _Index(index), _Pages(first, self.others, name)
            yield from ByEntity.handleInputRows(self, entity, iter(of_entity), timerValues)
            lines[name] = [self.index.text, self.pages.first]
        _keep(self.known, lines)


def stream_qc_state(spark: SparkSession, landing: str, out: str, checkpoint: str, trigger: dict | None = None, page: int = PAGE, buckets: int = BUCKETS) -> StreamingQuery:
    """Log lines landing in a folder, as appended changes of the events that they make or resolve."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    lines = spark.readStream.schema(LOG_SCHEMA).json(landing)
    steps = log_entries(lines).select(
        "level", "entity_id", "seq", F.col("at").cast("string").alias("at"),
        F.xxhash64("level", "entity_id", "kind", "op", "reason", "by", "qc_event_id", "source", "transaction_id").alias("tie"),
        "op", "kind", F.lit(None).cast("long").alias("opened"), "by", "reason", "qc_event_id", "source", "transaction_id", "withdrawal_date",
    )
    named = steps.filter(F.col("qc_event_id").isNotNull() & F.col("op").isin("open", "close"))
    # What the first operator does not read of an opening is neither dealt out nor kept by it.
    unread = ("by", "reason", "source", "transaction_id", "withdrawal_date")
    named = named.withColumns({c: F.when(F.col("op") != "open", F.col(c)) for c in unread})
    dealt = lambda rows, *by: rows.withColumn("of_group", F.pmod(F.xxhash64(*by), F.lit(buckets))).groupBy("of_group")
    by_id = dealt(named, "qc_event_id").transformWithState(ByEventId(), _STEP, "append", "none")
    direct = steps.filter((F.col("qc_event_id").isNull() | (F.col("op") != "close")) & F.col("level").isNotNull() & F.col("entity_id").isNotNull())
    changes = dealt(direct.unionByName(by_id), "level", "entity_id").transformWithState(EntityGroup(page), _CHANGE, "append", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    return changes.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def state_events(changes: DataFrame, patients: DataFrame, specimens: DataFrame, assays: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """The event rows of known entities: the latest change of each, with ``withdrawal_date`` beside them."""
    frames = {"patient": patients, "specimen": specimens, "assay": assays}
    known = [frames[lv.name].select(F.lit(lv.name).alias("level"), F.col(lv.key).cast("string").alias("entity_id")) for lv in schema.levels]
    place = ["level", "entity_id", "kind", "seq", "at", "tie"]
    others = [c for c in changes.columns if c not in (*place, "_batch")]
    latest = changes.groupBy(*place).agg(F.max_by(F.struct(*others), "_batch").alias("_c")).select(*place, "_c.*").filter(~F.col("deleted"))
    ids = known[0]
    for rows in known[1:]:
        ids = ids.unionByName(rows)
    made = event_id(F.col("level"), F.col("entity_id"), F.col("kind"), F.concat_ws(":", "transaction_id", F.col("seq").cast("string")))
    return latest.join(ids, ["level", "entity_id"], "left_semi").select(
        F.coalesce("qc_event_id", made).alias("id"), "level", "entity_id", "kind", "reason", "source", F.col("at").cast("timestamp").alias("created_at"), "created_by",
        F.col("resolved_at").cast("timestamp").alias("resolved_at"), "resolved_by", "resolved_reason", "transaction_id", "withdrawal_date",
    ).select(*EVENT_COLUMNS, "withdrawal_date")
