"""The keyed log stream against the replay of the whole log, in any order of arrival."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_qc_and_log import cohort  # noqa: F401

from cohort_ledger import streaming
from cohort_ledger.operators import replay
from cohort_ledger.streaming import keyed

COLUMNS = ["id", "level", "entity_id", "kind", "reason", "source", "created_by", "resolved_by", "resolved_reason", "transaction_id"]


def log_lines(seed, known, n=160):
    """Opens, closes by key, by id (late, repeated, unknown, before their event) and batch reversals."""
    draw = random.Random(seed)
    owner, lines = {}, []
    for seq in range(n):
        level, entity = draw.choice(known)
        kind = draw.choice(["qc_fail", "qc_warn"])
        line = {"seq": seq, "timestamp": f"2024-01-01T00:{seq // 60:02d}:{seq % 60:02d}", "transaction_id": f"t{seq}", "reason": f"r{seq}"}
        what = draw.random()
        if what < 0.5:
            line |= {"action": "censor", "level": level, "entity_id": entity, "kind": kind, "created_by": "a"}
            if draw.random() < 0.7:
                line["qc_event_id"] = f"e{seq}"
                owner[f"e{seq}"] = (level, entity, kind)
        elif what < 0.92:
            named = draw.choice([None, *list(owner)[-5:], "unknown"])
            level, entity, kind = owner.get(named, (level, entity, kind))
            line |= {"action": "uncensor", "resolved_by": "b", "qc_event_id": named}
            if named not in owner or draw.random() < 0.5:
                line |= {"level": level, "entity_id": entity, "kind": kind}
        else:
            line |= {"action": "uncensor_batch", "batch_id": "b", "resolved_assays": [e for lv, e in known if lv == "assay"][:2]}
        lines.append(line)
    return lines


def expected(spark, lines, cohort):
    from cohort_ledger.model import LOG_SCHEMA

    log = spark.read.schema(LOG_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(x) for x in lines]))
    return events_of(replay.replay_qc_log(log, *cohort)["events"])


def events_of(events):
    times = [F.date_format(c, "HH:mm:ss").alias(c) for c in ("created_at", "resolved_at")]
    return sorted((tuple(r) for r in events.select(*COLUMNS, *times).collect()), key=str)


@pytest.mark.parametrize("seed, page", [(1, 256), (2, 3)])
def test_events_do_not_depend_on_arrival(spark, tmp_path, cohort, seed, page):  # noqa: F811
    known = [("assay", "A01"), ("assay", "A02"), ("patient", "P1"), ("specimen", "S_ABSENT")]
    lines = log_lines(seed, known)
    shuffled = lines + lines[:20]  # some lines are delivered twice
    random.Random(seed).shuffle(shuffled)
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    for wave in range(3):
        part = shuffled[wave::3]
        (landing / f"{wave}.json").write_text("".join(json.dumps(x) + "\n" for x in part))
        streaming.stream_qc_state(spark, str(landing), out, str(tmp_path / "ck"), page=page).awaitTermination()
        seen = [x for x in lines if x in [y for w in range(wave + 1) for y in shuffled[w::3]]]
        got = events_of(streaming.state_events(spark.read.parquet(out), *cohort))
        assert got == expected(spark, seen, cohort)


def test_walk_and_pages_agree():
    """A timeline in small pages gives the events of one walk, whatever the order of arrival."""
    draw = random.Random(3)

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Pages(dict):
        reads = 0

        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            Pages.reads += 1
            return self[key]

        updateValue = dict.__setitem__

    from pyspark.sql import Row

    steps = []
    for seq in range(600):
        op = draw.choice(["open", "open", "close", "close", "close_all"])
        opened = draw.randrange(max(seq - 8, 0), seq + 1) if op == "close" and draw.random() < 0.5 and seq else None
        steps.append([seq, f"{seq:04d}", 0, op, None if op == "close_all" else draw.choice("xy"), opened, "b", None, None, "s", "t", None])
    made = keyed.ByEntity(page=8)
    made.index, made.pages = State(), Pages()
    latest = {}
    order = steps[:500]
    draw.shuffle(order)
    for batch in [order[i : i + 50] for i in range(0, 500, 50)] + [[s] for s in steps[500:]]:
        Pages.reads = 0
        rows = [Row(**dict(zip(keyed._FIELDS, s, strict=True))) for s in batch]
        for change in made.handleInputRows(("assay", "A"), iter(rows), None):
            latest[change.seq] = change
    assert Pages.reads <= 2  # a line at the end touches the last page only
    _, events = keyed.walk(steps, {})
    assert {s: c.resolved_at for s, c in latest.items() if not c.deleted} == {opened[0]: closed[1] if closed else None for opened, closed in events.values()}


def test_a_group_costs_few_calls_of_the_state_store():
    """Entities of one group share one state value; further pages of a long timeline stand beside it."""
    from pyspark.sql import Row

    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Map(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    def rows(seqs, entities):
        named = [[s, f"{s:04d}", 0, op, "x", None, "b", None, "e\t\n", "s", "t", None] for s, op in seqs]
        return [Row(level="assay", entity_id=e, **dict(zip(keyed._FIELDS, step, strict=True))) for step in named for e in entities]

    group = keyed.EntityGroup(page=4)
    group.known, group.others = Value(), Map()
    entities = [f"A\t{n}\n" for n in range(100)]
    made = list(group.handleInputRows((0,), iter(rows([(2, "close")], entities)), None))
    assert made == [] and calls == ["update"]
    made = list(group.handleInputRows((0,), iter(rows([(1, "open")], entities)), None))
    assert sorted(c.entity_id for c in made) == sorted(entities) and {c.resolved_at for c in made} == {"0002"}
    assert calls == ["update", "get", "update"] and not group.others
    more = rows([(s, "open" if s % 2 else "close") for s in range(3, 31)], entities[:1])
    made = list(group.handleInputRows((0,), iter(more), None))
    assert {c.seq for c in made} == set(range(3, 31, 2)) and len(group.others) > 1
    assert len(calls) == 5


def test_state_is_packed():
    """A group's state is a small part of its text, and is read back whole."""
    from pyspark.sql import Row

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    def rows(seqs, op):
        named = [[s, f"{s:04d}", 0, op, "x", None, "someone", "the same reason é", f"e{s}", "import", f"txn{s}", None] for s in seqs]
        return [Row(level="assay", entity_id=f"A{n}", **dict(zip(keyed._FIELDS, step, strict=True))) for step in named for n in range(50)]

    group = keyed.EntityGroup(page=4)
    group.known, group.others = Value(), Map()
    assert len(list(group.handleInputRows((0,), iter(rows(range(1, 20, 2), "open")), None))) == 50
    text = "\n".join("\t".join([name, *fields]) for name, fields in keyed._lines(group.known).items())
    assert len(group.known.held[0]) < len(text.encode()) / 4
    assert all(len(v[0]) < 400 for v in group.others.values()) and group.others
    again = list(group.handleInputRows((0,), iter(rows([2], "close")), None))
    assert {(c.seq, c.reason, c.resolved_at) for c in again if c.seq == 1} == {(1, "the same reason é", "0002")} and len(again) == 100
