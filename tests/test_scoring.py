import random

from pyspark.sql import functions as F

from patchlight.operators import scoring as S

ISSUE = "pr_id long, ord long, file string, line int, title string, description string, impact_statement string, evidence array<string>, severity string"
GOLD = "pr_id long, ord long, id string, file string, line_start int, line_end int, title_keywords array<string>, evidence_keywords array<string>, severity string"
HUNKS = "pr_id long, file string, hunk int, start_line int, end_line int"
RANK = {"INFO": 0, "WARNING": 1, "ERROR": 2}


def hunk_of(line, hs):
    return next((i for i, (a, b) in enumerate(hs) if a - 1 <= line <= b + 1), None)


def pair_flags(i, g, hunks):
    """The matching rules for one pair, spelled out."""
    if i["file"] != g["file"]:
        return None
    hs = hunks.get(i["file"], [])
    known = i["line"] is not None and g["s"] is not None

    def near(gap, tol):
        if not known:
            return None
        if hs:
            a, b = hunk_of(i["line"], hs), hunk_of(g["s"], hs) or hunk_of(g["e"], hs)
            return a is not None and b is not None and abs(a - b) <= gap
        return g["s"] - tol <= i["line"] <= g["e"] + tol

    has = lambda ks: not ks or any(k.lower() in i["text"].lower() for k in ks)
    text = has(g["tk"]) or has(g["ek"])
    sev = not g["sev"] or RANK[i["sev"]] >= RANK[g["sev"]] - 1
    match = near(0, 5) in (True, None) and text and sev
    broad = bool(near(2, 50))
    reason = "severity_miss" if broad and text and not sev else ("line_offset" if (broad or text) and not match else None)
    return match, bool(near(1, 20)) or text, reason


def model(issues, golds, hunks):
    flags = {(i["ord"], g["ord"]): pair_flags(i, g, hunks) for i in issues for g in golds}
    cands = {i["ord"]: [g["ord"] for g in golds if (flags[i["ord"], g["ord"]] or (0,))[0]] for i in issues}
    taken, dup, loose = set(), 0, []
    for i in sorted(issues, key=lambda i: len(cands[i["ord"]]) or 999):
        c = cands[i["ord"]]
        if not c:
            loose.append(i["ord"])
            continue
        free = [x for x in c if x not in taken]
        if free:
            taken.add(free[0])
        else:
            dup += 1
    review, noise = set(), 0
    for o in loose:
        rs = [g["ord"] for g in golds if flags[o, g["ord"]] and flags[o, g["ord"]][1] and g["ord"] not in taken]
        if rs:
            review.add(rs[0])
        else:
            noise += 1
    misses = [g["ord"] for g in golds if g["ord"] not in taken]
    reasons = [next((flags[i["ord"], m][2] for i in issues if flags[i["ord"], m] and flags[i["ord"], m][2]), "not_detected") for m in misses]
    return dict(expected_total=len(golds), issue_total=len(issues), hit_count=len(taken), miss_count=len(misses), review_count=len(review), noise_count=noise,
                duplicate_count=dup, not_detected=reasons.count("not_detected"), line_offset=reasons.count("line_offset"), severity_miss=reasons.count("severity_miss"),
                clean_false_positives=0 if golds else noise)


def test_sample_scores_against_a_row_by_row_model(spark):
    rnd = random.Random(11)
    words = ["null", "leak", "sql", "race", "type"]
    ri, rg, rh, want = [], [], [], {}
    for pr in range(25):
        hunks = {"a": [(5, 12), (40, 45), (80, 99)]} if pr % 3 else {}
        rh += [(pr, f, k, a, b) for f, hs in hunks.items() for k, (a, b) in enumerate(hs)]
        issues, golds = [], []
        for o in range(rnd.randrange(0, 14)):
            i = dict(ord=o, file=rnd.choice("ab"), line=rnd.choice([None, *range(1, 100, 7)]), text=" ".join(rnd.sample(words, 2)), sev=rnd.choice(list(RANK)))
            issues.append(i)
            ri.append((pr, o, i["file"], i["line"], i["text"], "", None, None, i["sev"]))
        for o in range(rnd.randrange(0, 6) if pr % 5 else 0):
            s = rnd.choice([None, *range(1, 100, 9)])
            g = dict(ord=o, file=rnd.choice("ab"), s=s, e=None if s is None else s + 3, tk=rnd.sample(words, rnd.randrange(0, 2)) or ["zzz"],
                     ek=rnd.sample(words, 1), sev=rnd.choice([*RANK, None]))
            golds.append(g)
            rg.append((pr, o, f"g{o}", g["file"], g["s"], g["e"], g["tk"], g["ek"], g["sev"]))
        want[pr] = model(issues, golds, hunks)
    scores = S.score_samples(spark.range(25).select(F.col("id").alias("pr_id")), spark.createDataFrame(ri, ISSUE), spark.createDataFrame(rg, GOLD), spark.createDataFrame(rh, HUNKS))
    rows = {r.pr_id: {k: r[k] for k in want[0]} for r in scores.collect()}
    assert rows == want
    assert all(r["hit_count"] + r["miss_count"] == r["expected_total"] for r in rows.values())
    t = S.totals(scores).first()
    assert t.samples == 25 and t.hit_count == sum(w["hit_count"] for w in want.values())


def _pair_tables(spark, r, n_issues, n_goldens):
    """One file with hunks and one without; keywords of one to eight characters, parts of words, empty words and empty lists."""
    vocab = ["nullable", "leak", "sql-injection", "race", "a.b", "é", "pool", "x"]
    keys = ["null", "leak", "l-in", "race condition", "a.b", "É", "ool", "x", "zz", "", None]
    issues = [(1, o, r.choice("ab"), r.choice([None, r.randrange(400)]), " ".join(r.sample(vocab, 2)), r.choice(["", "Race condition"]), None, None, r.choice(list(RANK)))
              for o in range(n_issues)]
    golds = []
    for o in range(n_goldens):
        s = r.choice([None, r.randrange(400)])
        lists = [r.sample(keys[: 9 if o % 9 else 11], 2) if r.random() < 0.9 else r.choice([[], None]) for _ in range(2)]
        golds.append((1, o, f"g{o}", r.choice("ab"), s, None if s is None else s + r.randrange(9), *lists, r.choice([*RANK, None])))
    hunks = [(1, "a", k, 20 * k, 20 * k + 9) for k in range(20)]
    return spark.createDataFrame(issues, ISSUE), spark.createDataFrame(golds, GOLD), spark.createDataFrame(hunks, HUNKS)


def test_pairs_of_large_files_equal_all_pairs(spark):
    """Two searches instead of all pairs of a file give the same flags."""
    tables = _pair_tables(spark, random.Random(4), 90, 40)
    rows = lambda direct: sorted(map(repr, S.issue_pairs(*tables, direct).collect()))
    searched = rows(0)
    assert searched == rows(10**9) and 100 < len(searched) < 90 * 40 / 2
    assert rows(1800) == searched


def test_large_file_makes_no_product(spark):
    """3,000 issues and 3,000 goldens of one file with one partner each: rows follow the partners."""
    issues = spark.range(3000).selectExpr(
        "1L AS pr_id", "id AS ord", "'a' AS file", "cast(id * 200 AS int) AS line", "concat('finding number ', id, ' end') AS title", "'' AS description",
        "'' AS impact_statement", "cast(null AS array<string>) AS evidence", "'ERROR' AS severity")
    golds = spark.range(3000).selectExpr(
        "1L AS pr_id", "id AS ord", "concat('g', id) AS id", "'a' AS file", "cast(id * 200 AS int) AS line_start", "cast(id * 200 + 3 AS int) AS line_end",
        "array(concat('number ', id, ' e')) AS title_keywords", "array('nowhere') AS evidence_keywords", "'ERROR' AS severity")
    pairs = S.issue_pairs(issues, golds, spark.createDataFrame([], HUNKS))
    assert pairs.where("is_match AND issue_ord = expected_ord").count() == pairs.count() == 3000


def test_scoring_reads_issues_twice(spark, monkeypatch):
    """Once for the numbers of issues by line, once for the pairs; whether tables are handed to every task or dealt changes nothing."""
    issues, golds, hunks = _pair_tables(spark, random.Random(9), 120, 30)
    samples = spark.range(3).select(F.col("id").alias("pr_id"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = S.score_samples(samples, issues.mapInArrow(counted, ISSUE), golds, hunks).collect()
    assert read.value == 2 * 120
    monkeypatch.setattr(S, "HELD_ROWS", 0)
    assert sorted(S.score_samples(samples, issues, golds, hunks).collect()) == sorted(got) and sum(r.issue_total for r in got) == 120


def test_best_confidence_against_a_row_by_row_model(spark):
    rnd = random.Random(2)
    rows, want = [], set()
    for pr in range(20):
        c = {(g, f): rnd.choice([0.4, 0.5, 0.6, 0.7, 0.8]) for g in range(5) for f in range(8) if rnd.random() < 0.6}
        rows += [(pr, g, f, x) for (g, f), x in c.items()]
        used = set()
        for g in range(5):
            best = max(((x, -f) for (g2, f), x in c.items() if g2 == g and f not in used and x > 0.5), default=None)
            if best:
                used.add(-best[1])
                want.add((pr, g, -best[1]))
    goldens = spark.createDataFrame([(p, g) for p in range(20) for g in range(5)], "pr_id long, ord long")
    got = S.match_best_confidence(spark.createDataFrame(rows, "pr_id long, golden_ord long, finding_ord long, conf double"), goldens)
    assert {(r.pr_id, r.golden_ord, r.finding_ord) for r in got.collect()} == want


def test_score_prs_empty_sides(spark):
    prs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "pr_id long")
    g = spark.createDataFrame([(1, "null value in loop"), (2, "null value")], "pr_id long, text string")
    f = spark.createDataFrame([(1, "the null value in the loop"), (1, "zebra"), (3, "x")], "pr_id long, text string")
    got = {r.pr_id: (r.precision, r.recall, r.note) for r in S.score_prs(prs, g, f).collect()}
    assert got == {1: (0.5, 1.0, None), 2: (None, 0.0, "nothing reported"), 3: (0.0, None, "no golden comments available"), 4: (None, None, "no goldens and no findings")}


def test_f1_and_rates(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 0.0), (0.5, 1.0)], "p double, r double")
    assert [r.f for r in df.select(S.f1(F.col("p"), F.col("r")).alias("f")).collect()] == [None, 0.0, 0.667]


def test_sampled_pairs_are_real_and_distinct(spark):
    g = spark.range(40).select((F.col("id") % 4).alias("pr_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("text"))
    f = spark.range(60).select((F.col("id") % 5).alias("pr_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("text"))
    rows = S.sample_pairs(g, f, 30).collect()
    assert len({(r.golden_ord, r.finding_ord) for r in rows}) == len(rows) == 30
    assert all(r.golden_ord % 4 == r.finding_ord % 5 == r.pr_id for r in rows)
