"""State transitions: consecutive positions, stage days, ordering and node numbering."""

from __future__ import annotations

from vitaplate.operators import transitions as TR

SCHEMA = "id string, compound string, day long, ml_live int, vd_live int, intensity double"


def _visits(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _obj(oid, days, calls, comp="Media"):
    return [(oid, comp, d, m, v, float(i)) for i, (d, (m, v)) in enumerate(zip(days, calls))]


def test_cohort_requires_five_visits_and_drops_day_2(spark):
    rows = _obj("a", [0, 1, 2, 3, 7], [(1, 1)] * 5) + _obj("b", [0, 1, 2, 3], [(1, 1)] * 4)
    cohort = TR.tracked_cohort(_visits(spark, rows))
    got = sorted((r.id, r.day) for r in cohort.collect())
    assert got == [("a", 0), ("a", 1), ("a", 3), ("a", 7)]


def test_links_follow_consecutive_positions(spark):
    LL, LD, DD = (1, 1), (1, 0), (0, 0)
    rows = (
        _obj("a", [0, 1, 2, 3, 7], [LL, LD, LL, DD, DD])          # 0->1, 1->3, 3->7
        + _obj("b", [0, 1, 2, 3, 7, 8], [LL, LD, LL, DD, DD, LL])  # same, extra visit
        + _obj("c", [0, 2, 3, 7, 8], [LL, LL, LL, LL, LL])         # day 1 missing: no 0->3 link
    )
    links = TR.transition_links(TR.tracked_cohort(_visits(spark, rows)))
    got = sorted((r.stage, r.source, r.target, r["count"], r.group) for r in links.collect())
    assert got == [
        (1, "0_L-ML_L-VD", "1_L-ML_D-VD", 2, "type_b"),
        (2, "1_L-ML_D-VD", "3_D-ML_D-VD", 2, "type_a"),
        (3, "3_D-ML_D-VD", "7_D-ML_D-VD", 2, "type_b"),
    ]
    assert sum(r["count"] for r in links.collect()) == 6


def test_link_order_and_nodes(spark):
    LL, DD, LD = (1, 1), (0, 0), (1, 0)
    rows = (
        _obj("a", [0, 1, 2, 3, 7], [LL, DD, LL, DD, LL])
        + _obj("b", [0, 1, 2, 3, 7], [DD, LL, LL, LD, DD])
        + _obj("c", [0, 1, 2, 3, 7], [LL, LL, LL, LD, DD])
    )
    links = TR.transition_links(TR.tracked_cohort(_visits(spark, rows)))
    ordered = [(r.source, r.target) for r in links.orderBy("link_order").collect()]
    # stage 1: source code descending (LL=4 before DD=1), targets ascending (DD=1 before LL=4)
    assert ordered[:3] == [("0_L-ML_L-VD", "1_D-ML_D-VD"), ("0_L-ML_L-VD", "1_L-ML_L-VD"), ("0_D-ML_D-VD", "1_L-ML_L-VD")]
    nodes, with_ids = TR.transition_nodes(links)
    names = [r.name for r in nodes.orderBy("node_id").collect()]
    sources = []
    for s, _ in ordered:
        if s not in sources:
            sources.append(s)
    assert names[: len(sources)] == sources
    groups = {r.name: r.node_group for r in nodes.collect()}
    assert groups["0_L-ML_L-VD"] == "a" and groups["3_L-ML_D-VD"] == "b"
    for r in with_ids.collect():
        assert names[r.id_source] == r.source and names[r.id_target] == r.target


def test_groups_are_counted_separately(spark):
    LL = (1, 1)
    rows = _obj("a", [0, 1, 2, 3, 7], [LL] * 5, "Media") + _obj("a", [0, 1, 2, 3, 7], [LL] * 5, "STA")
    links = TR.transition_links(TR.tracked_cohort(_visits(spark, rows)))
    assert sorted((r.compound, r.stage, r["count"]) for r in links.collect()) == [
        ("Media", 1, 1), ("Media", 2, 1), ("Media", 3, 1), ("STA", 1, 1), ("STA", 2, 1), ("STA", 3, 1)]


def test_custom_stages(spark):
    LL, DD = (1, 1), (0, 0)
    rows = _obj("a", [0, 1, 2, 3, 7], [LL, DD, LL, DD, LL]) + _obj("b", [0, 1, 2, 3, 7], [LL, LL, DD, DD, LL])
    cohort = TR.tracked_cohort(_visits(spark, rows), drop_day=-1)  # keep day 2
    links = TR.transition_links(cohort, stages=((2, 1, 2), (4, 3, 7)))
    got = sorted((r.stage, r.source, r.target, r["count"]) for r in links.collect())
    assert got == [(1, "1_D-ML_D-VD", "2_L-ML_L-VD", 1), (1, "1_L-ML_L-VD", "2_D-ML_D-VD", 1),
                   (2, "3_D-ML_D-VD", "7_L-ML_L-VD", 2)]


def test_links_equal_brute_force_on_surrogate(spark):
    from collections import Counter

    from tests.conftest import SF_CHECK, SF_SMALL
    from vitaplate.plans import surrogates as S

    for sf in (SF_SMALL, SF_CHECK):
        cohort = TR.tracked_cohort(S.visits(spark, sf))
        rows = sorted((r.compound, r.id, r.day, r.status, r.intensity) for r in cohort.collect())
        by_obj = {}
        for comp, oid, day, status, inten in rows:
            by_obj.setdefault((comp, oid), []).append((day, status))
        want = Counter()
        for (comp, _), visits in by_obj.items():
            for stage, (pos, d0, d1) in enumerate(TR.STAGES, start=1):
                if len(visits) > pos and visits[pos - 1][0] == d0 and visits[pos][0] == d1:
                    s0, s1 = visits[pos - 1][1], visits[pos][1]
                    if s0 != "0" and s1 != "0":
                        want[(comp, stage, f"{d0}_{s0}", f"{d1}_{s1}")] += 1
        links = TR.transition_links(cohort)
        got = Counter({(r.compound, r.stage, r.source, r.target): r["count"] for r in links.collect()})
        assert got == want and sum(want.values()) > 0
