import itertools
import random

import pytest
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.operators import diff as D
from patchlight.operators import findings as O
from patchlight.operators.similar import salted_first, similar_sets

SCHEMA = (
    "pr_id long, ord long, file string, line int, title string, description string, severity string, confidence double, category string,"
    " impact_type string, impact_statement string, diff_snippet string, evidence array<string>, evidence_source string, token_cost double"
)


def finding(ord, **kw):
    base = dict(pr_id=1, ord=ord, file="a.py", line=1, title="t", description="d", severity="ERROR", confidence=0.9, category="quality",
                impact_type="runtime_error", impact_statement="breaks", diff_snippet=None, evidence=["x"], evidence_source="DIFF", token_cost=0.0)
    base.update(kw)
    return tuple(base.values())


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ords(df):
    return sorted(r.ord for r in df.select("ord").collect())


def test_gate(spark):
    diff = "+++ b/a.py\n@@ -1,2 +1,4 @@\n ctx\n+code()\n+# note\n+*args"
    lines = D.diff_lines(spark.createDataFrame([(1, diff)], "pr_id long, diff string"))
    rows = [
        finding(0, line=1), finding(1, line=2), finding(2, line=3), finding(3, line=4), finding(4, line=99), finding(5, line=None),
        finding(6, line=2, severity="INFO"), finding(7, line=2, severity="WARNING", confidence=1.0), finding(8, line=99, evidence_source="CONTEXT"),
        finding(9, line=98, evidence_source="CONTEXT", evidence=[]), finding(10, file="other.py", line=2), finding(11, line=2, confidence=0.95),
    ]
    gated = O.publication_gate(table(spark, rows), lines)
    assert ords(gated) == [0, 3, 5, 8, 11]
    assert ords(O.publication_gate(gated, lines)) == [0, 3, 5, 8, 11]
    assert ords(O.publication_gate(table(spark, [finding(0, line=1), finding(1, line=2, evidence=["+code"]), finding(2, line=2, title="u", evidence=["zzz"])]), lines, True)) == [1]


def test_exact_dedup_keeps_best_severity_then_first(spark):
    rows = [finding(0, severity="WARNING"), finding(1), finding(2, confidence=1.0), finding(3, line=None), finding(4, line=None)]
    assert ords(O.dedup_exact(table(spark, rows))) == [1, 3]


def test_semantic_dedup_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["null", "crash", "loop", "cache", "slow", "value", "call", "type"]
    rows = []
    for i in range(300):
        rows.append(finding(i, file=rnd.choice(["a", "b"]), line=rnd.choice([None, *range(1, 30)]), title=" ".join(rnd.sample(words, 5)),
                            description=" ".join(rnd.sample(words, 2)), severity=rnd.choice(["ERROR", "WARNING", "INFO"]), confidence=rnd.choice([0.5, 0.9])))
    rank = {"ERROR": 0, "WARNING": 1, "INFO": 2}
    recs = [dict(o=r[1], f=r[2], l=r[3], w=set((r[4] + " " + r[5]).split()), k=(rank[r[6]], -r[7], r[1])) for r in rows]
    want = [a["o"] for a in recs if a["l"] is None or not any(
        b["l"] is not None and b["f"] == a["f"] and abs(b["l"] - a["l"]) <= 3 and b["k"] < a["k"] and len(a["w"] & b["w"]) / len(a["w"] | b["w"]) >= 0.8 for b in recs)]
    got = ords(O.semantic_dedup(table(spark, rows)))
    assert got == sorted(want) and len(got) < 300


def test_similar_sets_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    left = [(rnd.randrange(3), rnd.sample(vocab, rnd.randrange(1, 9))) for _ in range(80)]
    right = [(rnd.randrange(3), rnd.sample(vocab, rnd.randrange(1, 9))) for _ in range(80)]
    for t in (0.3, 0.5, 0.8):
        want = {(k, tuple(sorted(a)), tuple(sorted(b))) for (k, a), (k2, b) in itertools.product(left, right)
                if k == k2 and len(set(a) & set(b)) / len(set(a) | set(b)) >= t}
        got = similar_sets(spark.createDataFrame(left, "k long, words array<string>"), spark.createDataFrame(right, "k long, words array<string>"), ["k"], t).collect()
        assert len(got) == len(want) and {(r.k, tuple(r.lw), tuple(r.rw)) for r in got} == want


def test_salted_first_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, 7).otherwise(2).alias("n"))
    got = salted_first(df, ["k"], [F.col("o").desc()], F.col("o"), F.col("n")).collect()
    assert sorted(r.o for r in got if r.k) == sorted(range(4998, 4977, -3))
    assert sorted(r.o for r in got if not r.k) == [4997, 4999]


def test_noise_rules(spark):
    rows = [
        finding(0), finding(1, confidence=0.5), finding(2, impact_type="injection"), finding(3, impact_statement=" "), finding(4, impact_type=None),
        finding(5, category="security", file="src/x.tsx", title="IDOR", description="id from url"),
        finding(6, category="security", file="src/x.tsx", title="IDOR", description="id from url in middleware"),
        finding(7, category="security", file="src/x.py", title="IDOR", description="id from url"),
        finding(8, category="performance", severity="WARNING", title="could be faster"), finding(9, category="performance", severity="WARNING", title="could be faster, p95 doubled"),
        finding(10, impact_type=" Runtime_Error "),
    ]
    assert ords(O.reduce_noise(table(spark, rows))) == [0, 6, 7, 9, 10]


def test_category_guess(spark):
    rows = [finding(0, title="sql injection", description="x"), finding(1, title="slow query", description=""), finding(2, title="plain", description="text"),
            finding(3, title="null", description="", category="quality"), finding(4, title="sql query", description="")]
    got = {r.ord: r.category for r in O.recategorize(table(spark, rows)).collect()}
    assert got == {0: "security", 1: "performance", 2: "quality", 3: "quality", 4: "security"}


def test_contradicted_claims_are_dropped(spark):
    rows = [finding(0, title="Missing import ./util"), finding(1, title="odd ./util"), finding(2, title="Missing import ./other"), finding(3, file="b", title="Missing import ./util")]
    checks = spark.createDataFrame([(1, "a.py", "./util", "pass"), (1, "a.py", "./other", "fail")], "pr_id long, file string, module string, status string")
    assert ords(O.drop_import_claims(table(spark, rows), checks)) == [1, 2, 3]


def test_decisions_cover_changes_without_findings(spark):
    prs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "pr_id long")
    rows = [finding(0, pr_id=1), finding(1, pr_id=2, severity="WARNING"), finding(2, pr_id=3, severity="INFO")]
    got = {r.pr_id: (r.merge_decision, r.final_decision, r.risk_level) for r in O.decisions(prs, table(spark, rows)).collect()}
    assert got == {1: ("REQUEST_CHANGES", "REQUEST_CHANGES", "HIGH"), 2: ("COMMENT", "COMMENT", "MEDIUM"), 3: ("APPROVE", "COMMENT", "LOW"), 4: ("APPROVE", "APPROVE", "LOW")}


def test_review_without_a_reviewer_that_succeeded(spark):
    from patchlight.plans import review as R

    outcomes = spark.createDataFrame(
        [(1, 1, "security", "timeout", "t"), (1, 0, "quality", "format_error", None), (2, 0, "quality", "timeout", "t"), (3, 0, "quality", "success", None), (3, 1, "security", "timeout", "x")],
        "pr_id long, place int, agent string, status string, error_message string")
    scanner = spark.createDataFrame([(2, "s"), (9, "s")], "pr_id long, title string")
    checks = spark.createDataFrame([(3, "c")], "pr_id long, title string")
    said = spark.createDataFrame([(1, "quality", "lost"), (3, "quality", "kept"), (3, "security", "lost")], "pr_id long, agent string, title string")
    joined, fails = R.review_input(said, outcomes, scanner, checks)
    assert {(r.pr_id, r.failed, r.aborted, r.error) for r in fails.collect()} == {
        (1, 2, True, "no reviewer succeeded: quality(format_error: ); security(timeout: t)"), (2, 1, False, None), (3, 1, False, None)}
    assert {(r.source_no, r.pr_id, r.title) for r in joined.collect()} == {(0, 3, "kept"), (1, 2, "s"), (1, 9, "s"), (2, 3, "c")}


def test_reviews_of_a_run_written_again_replace_it(spark, tmp_path):
    from patchlight.sources import landed as L

    rows = lambda run, n: spark.createDataFrame([(run, k, "x") for k in range(n)], "run_id string, pr_id long, title string")
    for run, n in (("a", 3), ("b", 2), ("a", 4)):
        L.write_reviews(rows(run, n), str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).groupBy("run_id").count()
    assert {(r.run_id, r["count"]) for r in got.collect()} == {("a", 4), ("b", 2)}


def test_posted_review_of_a_large_change(spark):
    from patchlight.plans import report as RP

    summary = spark.createDataFrame([(1, "HIGH", "s", 900), (2, "LOW", "t", 3)], "pr_id long, risk_level string, summary string, changed_lines long")
    coverage = spark.createDataFrame([(1, 40, 30, True, ["a", "b", "c", "d", "e"], 7), (2, 1, 1, False, None, 0)],
                                     "pr_id long, total long, reviewed long, is_large_pr boolean, skipped_first array<string>, skipped_mechanical long")
    fallback = spark.createDataFrame([(1, 5, "ERROR", "f.py", "boom")], "pr_id long, ord long, severity string, file string, title string")
    walk = spark.createDataFrame([(1, 0, "f.py", "adds f"), (1, 1, "g.py", "drops g")], "pr_id long, ord long, file string, note string")
    text = lambda df, pr: "\n".join(r.text for r in df.where(F.col("pr_id") == pr).orderBy("part", "ord").collect())
    plain, whole = RP.review_body(summary, coverage, fallback), RP.review_body(summary, coverage, fallback, walk)
    assert "30 of 40 files were read (900 changed lines)" in text(plain, 1) and "`a`, `b`, `c`, `d`, `e` and 2 more" in text(plain, 1)
    assert text(plain, 2) == text(whole, 2) and "Large" not in text(plain, 2)
    lines = text(whole, 1).split("\n")
    assert lines.index("| `f.py` | adds f |") < lines.index("| `g.py` | drops g |") < lines.index("| **[blocking]** 🔴 | `f.py` | boom |")
    added = ["| `f.py` | adds f |", "| `g.py` | drops g |", *C.REVIEW_WALKTHROUGH.split("\n")]
    assert [x for x in lines if x and x not in added] == [x for x in text(plain, 1).split("\n") if x]


def test_comment_with_a_suggestion(spark):
    row = spark.createDataFrame([("ERROR", "t", "d", None, "", "use x"), ("INFO", "t", "d", "perf", "slow", None)],
                                "severity string, title string, description string, impact_type string, impact_statement string, fix string")
    got = [r.b for r in row.select(O.inline_body(F.col("fix")).alias("b")).collect()]
    assert got[0].endswith("d\n\n" + C.INLINE_SUGGESTION + "use x") and C.INLINE_IMPACT not in got[0]
    assert got[1].endswith("d\n\n" + C.INLINE_IMPACT + "`perf`\n\n" + C.INLINE_CONSEQUENCE + "slow")


@pytest.mark.parametrize("reach", [0, 3, 40])
def test_semantic_dedup_against_a_scan_moves_no_words_with_its_pairs(spark, monkeypatch, reach):
    """lines on both sides of bucket borders, sets that are alike, and findings without line or words."""
    rnd = random.Random(reach)
    texts = ["a b c d e", "a b c d f", "a b c d e f", "g h i j k l m n o p", "g h i j k l m n o q", "", "a b c d e x y"]
    rows = [(rnd.randrange(2), k, rnd.choice("pq"), rnd.choice([None, *range(1, 70)]), rnd.choice(texts), rnd.choice(["ERROR", "INFO"]), rnd.choice([0.2, 0.9]))
            for k in range(160)]
    frame = spark.createDataFrame([(*r[:5], "", *r[5:]) for r in rows], "pr_id long, ord long, file string, line int, title string, description string, severity string, confidence double")
    cuts, cut = [], O.cut_lineage
    monkeypatch.setattr(O, "cut_lineage", lambda df: cuts.append(df.columns) or cut(df))
    got = {r.ord for r in O.semantic_dedup(frame, 0.6, reach).collect()}

    def rank(r):
        return ({"ERROR": 0, "INFO": 2}[r[5]], -r[6], r[1])

    def same(x, y):
        a, b = set(x[4].split()), set(y[4].split())
        near = x[3] is not None and y[3] is not None and abs(x[3] - y[3]) <= reach
        return x[0] == y[0] and x[2] == y[2] and near and a and b and len(a & b) / len(a | b) >= 0.6

    assert got == {x[1] for x in rows if not any(rank(y) < rank(x) and same(x, y) for y in rows)}
    assert cuts[1:] == [["pr_id", "ord", "_h", "_h2"]]
