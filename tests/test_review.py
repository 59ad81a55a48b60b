"""Labels, status, counts and views against a plain model."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from countersign import ReviewRules
from countersign import operators as op
from countersign.functions import instant, iso_stamp
from countersign.operators.status import open_item
from countersign.sources import append_submissions
from tests import model

RULES = ReviewRules.of("A", "B")
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
OPEN = datetime(2024, 1, 31, tzinfo=timezone.utc)
CLOSED = OPEN - timedelta(seconds=1)
DATE = "2024-01-30"
LABELS = "tx_id string, reviewer string, assignment string, ts timestamp, seq bigint"


def labels_of(spark, *events):
    """Events as (key, reviewer, label) or with (ts, seq) given."""
    rows = [
        e if len(e) == 5 else (*e, START + timedelta(minutes=i), i) for i, e in enumerate(events)
    ]
    return spark.createDataFrame(rows, LABELS)


def transactions(spark, *keys):
    rows = [(key, i, float(i)) for i, key in enumerate(keys)]
    return spark.createDataFrame(rows, "tx_id string, row_idx bigint, amount double")


def judged(spark, keys, events, *, moment=OPEN, rules=RULES, date=DATE):
    frame = op.review(transactions(spark, *keys), labels_of(spark, *events), rules, date, moment)
    return {r.tx_id: (r.submitted, r.conflict, r.status) for r in frame.collect()}


CASES = {
    "none": ([], (False, False, "PENDING")),
    "one": ([("A", "A")], (False, False, "PENDING")),
    "same": ([("A", "Split"), ("B", "Split")], (True, False, "ASSIGNED")),
    "unsure twice": ([("A", "Unsure"), ("B", "Unsure")], (True, False, "ASSIGNED")),
    "different": ([("A", "A"), ("B", "B")], (True, True, "CONFLICT")),
    "agreed later": ([("A", "A"), ("B", "B"), ("A", "B")], (True, False, "ASSIGNED")),
    "parted later": ([("A", "A"), ("B", "A"), ("B", "Other")], (True, True, "CONFLICT")),
    "null": ([("A", "A"), ("B", None)], (False, False, "PENDING")),
    "null twice": ([("A", None), ("B", None)], (False, False, "PENDING")),
    "taken back": ([("A", "A"), ("B", "B"), ("B", None)], (False, False, "PENDING")),
    "empty": ([("A", "A"), ("B", "")], (True, True, "CONFLICT")),
    "empty twice": ([("A", ""), ("B", "")], (True, False, "ASSIGNED")),
    "outsider": ([("A", "A"), ("guest", "B")], (False, False, "PENDING")),
    "outsider differs": ([("A", "A"), ("B", "A"), ("guest", "B")], (True, False, "ASSIGNED")),
    "case matters": ([("A", "split"), ("B", "Split")], (True, True, "CONFLICT")),
}


def case_events():
    return [(name, *label) for name, (labels, _) in CASES.items() for label in labels]


def test_status_cases(spark):
    got = judged(spark, CASES, case_events())
    assert got == {name: expected for name, (_, expected) in CASES.items()}


def test_closed_gate_shows_disagreement_as_assigned(spark):
    got = judged(spark, ["different"], case_events(), moment=CLOSED)
    assert got == {"different": (True, False, "ASSIGNED")}


@pytest.mark.parametrize(
    "date, expected", [(None, "ASSIGNED"), ("", "ASSIGNED"), ("soon", "CONFLICT")]
)
def test_missing_and_unreadable_batch_date(spark, date, expected):
    assert judged(spark, ["different"], case_events(), date=date)["different"][2] == expected


def test_rules_without_grace_period_need_no_date(spark):
    rules = ReviewRules.of("A", "B", grace_hours=None, unsure=False)
    assert rules.options == ("A", "B", "Split", "Other")
    got = judged(spark, ["different"], case_events(), rules=rules, date=None)
    assert got["different"] == (True, True, "CONFLICT")


def test_three_reviewers_can_conflict_before_all_submitted(spark):
    rules = ReviewRules.of("A", "B", "C")
    got = judged(spark, ["x", "y"], [("x", "A", "A"), ("x", "C", "B")], rules=rules)
    assert got == {"x": (False, True, "CONFLICT"), "y": (False, False, "PENDING")}


def test_single_reviewer_never_conflicts(spark):
    rules = ReviewRules.of("A")
    got = judged(spark, ["x", "y"], [("x", "A", "A"), ("x", "B", "B")], rules=rules)
    assert got == {"x": (True, False, "ASSIGNED"), "y": (False, False, "PENDING")}


def test_rules_reject_bad_rosters():
    for names in ((), ("A", "A")):
        with pytest.raises(ValueError):
            ReviewRules.of(*names)
    with pytest.raises(ValueError):
        RULES.position("guest")


def test_submit_and_edit(spark, tmp_path):
    # Literal transactions; their ids number the rows of each day.
    days = ["2026-04-03", "2026-04-03", "2026-04-02"]
    ids = ["2026-04-03-0", "2026-04-03-1", "2026-04-02-0"]
    rows = [(key, i, day, 10.0 * i, f"shop {i}") for i, (key, day) in enumerate(zip(ids, days))]
    tx = spark.createDataFrame(
        rows, "tx_id string, row_idx bigint, date string, amount double, description string"
    )
    path, later = str(tmp_path / "labels"), START + timedelta(hours=1)
    steps = [
        (tx, "A", "Split", START, 0),
        (tx.where("date = '2026-04-03'"), "B", "Split", START, 1),
        (tx.where("row_idx = 1"), "B", "Other", later, 2),
    ]
    for chosen, who, label, at, seq in steps:
        append_submissions(op.submit(chosen, RULES, who, label, at, seq), path)
    got = op.review(tx, spark.read.parquet(path), RULES, DATE, OPEN)
    statuses = [r.status for r in got.orderBy("row_idx").collect()]
    assert statuses == ["ASSIGNED", "CONFLICT", "PENDING"]
    append_submissions(op.submit(tx.where("row_idx = 1"), RULES, "A", "Other", later, 3), path)
    got = op.review(tx, spark.read.parquet(path), RULES, DATE, OPEN)
    assert got.where("row_idx = 1").head().status == "ASSIGNED"
    for who, label in (("guest", "A"), ("A", "Rent")):
        with pytest.raises(ValueError):
            op.submit(tx, RULES, who, label, START, 4)


def test_equal_stamps_are_ordered_by_sequence(spark):
    events = [("x", "A", label, START, seq) for label, seq in [("B", 7), ("Split", 9), ("A", 8)]]
    (row,) = op.latest_assignment(labels_of(spark, *events)).collect()
    assert (row.assignment, row.seq) == ("Split", 9)


def test_resubmitting_changes_only_the_stamp(spark):
    once = [("x", "A", "A"), ("x", "B", "B")]
    twice = [*once, ("x", "A", "A")]
    assert judged(spark, ["x"], once) == judged(spark, ["x"], twice)
    stamps = [op.last_updated(labels_of(spark, *e)).head().last_updated for e in (once, twice)]
    assert stamps[0] < stamps[1]


def test_last_updated_counts_every_submitter(spark):
    rows = labels_of(spark, ("x", "A", "A"), ("x", "guest", "B"))
    both = op.last_updated(rows).select(iso_stamp("last_updated")).head()[0]
    state = op.review_state(rows, RULES, last_updated=True)
    assert both == state.select(iso_stamp("last_updated")).head()[0] == "2024-01-01T00:01:00.000Z"


def test_domain_and_roster(spark):
    rows = labels_of(
        spark, ("x", "A", "A"), ("x", "guest", "Unsure"), ("x", "B", "Rent"), ("x", "B", None)
    )
    assert [r.reviewer for r in op.roster_filter(rows, RULES).collect()] == ["A", "B", "B"]
    assert [r.assignment for r in op.option_domain(rows, RULES).collect()] == ["A", "Unsure"]
    assert [r.assignment for r in op.rejected_labels(rows, RULES).collect()] == ["Rent", None]
    narrow = ReviewRules.of("A", "B", unsure=False)
    assert [r.assignment for r in op.option_domain(rows, narrow).collect()] == ["A"]


def test_orphans_are_kept_but_never_counted(spark):
    tx, labels = transactions(spark, "x"), labels_of(spark, ("y", "A", "A"), ("y", "B", "B"))
    assert op.latest_assignment(labels).count() == 2
    assert tuple(op.review_stats(op.review(tx, labels, RULES, DATE, OPEN)).head()) == (1, 0, 0, 1)


def test_new_file_inherits_labels_by_position(spark):
    labels = labels_of(spark, ("2024-01-02-1", "A", "Split"), ("2024-01-02-1", "B", "Split"))
    rows = [(0, "2024-01-01", "new"), (1, "2024-01-02", "also new")]
    rows = spark.createDataFrame(rows, "row_idx bigint, date string, description string")
    tx = op.with_tx_id(rows)
    got = {r.description: r.status for r in op.review(tx, labels, RULES, DATE, OPEN).collect()}
    assert got == {"new": "PENDING", "also new": "ASSIGNED"}


def test_empty_transactions(spark):
    none = transactions(spark, "x").where("false")
    assert op.is_empty(none) and not op.is_empty(transactions(spark, "x"))
    reviewed = op.review(none, labels_of(spark, ("x", "A", "A")), RULES, DATE, OPEN)
    stats = op.review_stats(reviewed)
    assert tuple(stats.head()) == (0, 0, 0, 0)
    assert op.conflict_alert(stats, F.lit(True)).isEmpty()


def test_alert_and_banner(spark):
    reviewed = op.review(
        transactions(spark, *CASES), labels_of(spark, *case_events()), RULES, DATE, OPEN
    )
    stats = op.review_stats(reviewed)
    shown = op.conflict_alert(stats, F.lit(True)).head()
    assert shown.conflicts == 4
    assert shown.alert == "4 transaction(s) have conflicts that need resolution"
    assert shown.banner.startswith("Conflict Phase: ") and " 4 conflict(s) " in shown.banner
    assert op.conflict_alert(stats, F.lit(False)).head().banner is None


@pytest.mark.parametrize("seed, roster", [(0, "AB"), (1, "AB"), (2, "ABC"), (3, "ABC")])
def test_random_states(spark, seed, roster):
    rng, roster = random.Random(seed), tuple(roster)
    rules = ReviewRules.of(*roster)
    keys = [f"2024-01-0{1 + i % 3}-{i}" for i in range(30)]
    events = model.random_events(rng, keys, [*roster, "guest"], START, 150)
    state, stamps = model.replay(events)
    tx, labels = transactions(spark, *keys), labels_of(spark, *events).repartition(5)

    latest = {(r.tx_id, r.reviewer): r.assignment for r in op.latest_assignment(labels).collect()}
    assert latest == {(k, who): v for k, entry in state.items() for who, v in entry.items()}

    cut = START + timedelta(minutes=40)
    base = op.latest_assignment(labels.where(F.col("ts") < instant(cut)))
    merged = op.merge_state(base, labels.where(F.col("ts") >= instant(cut)))
    assert {(r.tx_id, r.reviewer): r.assignment for r in merged.collect()} == latest

    newest = op.last_updated(labels).select("tx_id", iso_stamp("last_updated")).collect()
    assert dict(map(tuple, newest)) == {
        k: v.strftime("%Y-%m-%dT%H:%M:%S.000Z") for k, v in stamps.items()
    }

    both = op.review_at(tx, labels, rules, DATE, [CLOSED, OPEN]).cache()
    got = {(r.phase, r.tx_id): (r.submitted, r.conflict) for r in both.collect()}
    assert got == {(g, k): model.judge(state, k, roster, g) for g in (False, True) for k in keys}
    stats = {r.phase: tuple(r)[1:] for r in op.review_stats(both, "phase").collect()}
    assert stats == {g: model.counts(state, keys, roster, g) for g in (False, True)}
    for total, assigned, conflicting, pending in stats.values():
        assert total == assigned + pending and conflicting <= pending
    left = op.remaining_by_reviewer(both, rules, "phase").collect()
    for gate in (False, True):
        expected = model.remaining(state, keys, roster, gate)
        assert {r.reviewer: r.remaining for r in left if r.phase == gate} == expected

    flags = op.review_flags(tx, op.review_state(labels, rules), rules, F.lit(True))
    assert tuple(op.review_stats(flags).head()) == model.counts(state, keys, roster, True)

    own = {k: state.get(k, {}).get("B") or None for k in keys}
    mine = op.own_submission(tx, labels, rules, "B")
    acts = mine.withColumn("action", op.next_action(F.col("own"))).collect()
    assert {r.tx_id: r.own for r in acts} == own
    assert all((r.action == "Edit") == bool(own[r.tx_id]) for r in acts)
    missing = op.unassigned_by_reviewer(tx, labels, rules, "B").collect()
    assert {r.tx_id for r in missing} == {k for k in keys if not own[k]}

    shown = {}
    for r in op.visible_assignments(both, rules, "B").collect():
        shown[r.phase, r.tx_id, r.reviewer] = r.shown
    expected = {(False, k, "B"): own[k] or "Not yet assigned" for k in keys}
    expected |= {(True, k, who): state.get(k, {}).get(who) or "—" for k in keys for who in roster}
    assert shown == expected

    judged_open = {k: model.judge(state, k, roster, True) for k in keys}
    order = sorted(keys, key=lambda k: judged_open[k][0] and not judged_open[k][1])
    reviewed = op.review(tx, labels, rules, DATE, OPEN)
    assert [r.tx_id for r in op.backlog(reviewed).collect()] == order
    matrix = op.tx_reviewer_matrix(op.with_labels(tx, op.review_state(labels, rules)), rules)
    assert {(r.tx_id, r.reviewer): r.assignment for r in matrix.collect()} == {
        (k, who): state.get(k, {}).get(who) for k in keys for who in roster
    }
    both.unpersist()


def test_summary_and_filters(spark):
    reviewed = op.review(
        transactions(spark, *CASES), labels_of(spark, *case_events()), RULES, DATE, OPEN
    )
    summary = op.review_summary(op.review_stats(reviewed)).head().asDict()
    expected = [e for _, e in CASES.values()]
    assert summary == {
        "resolved": sum(s == "ASSIGNED" for *_, s in expected),
        "conflicts": sum(s == "CONFLICT" for *_, s in expected),
        "remaining": sum(s != "ASSIGNED" for *_, s in expected),
    }
    assert op.conflicts(reviewed).count() == summary["conflicts"]
    assert op.fully_submitted(reviewed).count() == sum(s for s, *_ in expected)
    open_rows = reviewed.where(open_item(F.col("conflict"), F.col("submitted")))
    assert open_rows.count() == summary["remaining"]
