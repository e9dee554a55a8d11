import hashlib
import random

from pyspark.sql import functions as F

from sparkrank.llm.mixing import mix_sources, plan_budgets


def fill(children, budget):
    """children: {name: (weight, cap)}; a full child's shortage goes to the others by weight."""
    given, open_ = {}, {k: v for k, v in children.items() if v[0] > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: v for k, v in open_.items() if v[1] * total <= budget * v[0]}
        if not full:
            return given | {k: budget * w // total for k, (w, _) in open_.items()}
        k = min(full, key=lambda x: full[x][1] / full[x][0])
        given[k] = full[k][1]
        budget -= full[k][1]
        del open_[k]
    return given


def brute(docs, weight, budget, epochs, seed):
    leaves = {}
    for i, text, lang, source in docs:
        leaves.setdefault((source[:1], lang or "", source), []).append((i, len((text or "").split())))
    # what a leaf may give: nothing, if it or a node above it has weight 0
    cap = {k: epochs * sum(n for _, n in v) if all(weight(k[:depth]) > 0 for depth in (1, 2, 3)) else 0 for k, v in leaves.items()}

    def walk(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix})
        kids = {n: (weight(prefix + (n,)), sum(c for k, c in cap.items() if k[: len(prefix) + 1] == prefix + (n,))) for n in names}
        out = {}
        for n, b in fill(kids, budget).items():
            out |= walk(prefix + (n,), b)
        return out

    rows = []
    for leaf, b in walk((), min(budget, sum(cap.values()))).items():
        own, total = leaves[leaf], sum(n for _, n in leaves[leaf])
        whole, rest = (b // total, b % total) if total else (1, 0)
        rows += [(i, e) for i, _ in own for e in range(whole)]
        upto = 0
        for i, n in sorted(own, key=lambda x: hashlib.sha256(f"{seed}:{whole}:{x[0]}".encode()).hexdigest()):
            upto += n
            if rest and upto <= rest:
                rows.append((i, whole))
    return sorted(rows)


def test_matches_brute_force(spark):
    r = random.Random(9)
    docs = [(i, " ".join("x" * r.randint(1, 5) for _ in range(r.choice([0, 3, 40, 200]))), r.choice(["en", "de", None]), r.choice(["a1", "a2", "b1", "c1", "c2"])) for i in range(400)]
    docs += [(900, None, "en", "a1"), (901, "", "xx", "z9")]
    weights = {("a",): 5, ("b",): 9, ("*", "en"): 3, ("a", "en"): 7, ("*", "*", "c2"): 0, ("*", "*", "a2"): 2}

    def weight(path):
        fits = [p for p in weights if len(p) == len(path) and all(x in ("*", y) for x, y in zip(p, path))]
        return weights[max(fits, key=lambda p: (sum(x != "*" for x in p), p))] if fits else 1

    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    for budget in (0, 777, 9_000, 30_000, 10**7):
        got = sorted((x.doc_id, x.epoch) for x in mix_sources(frame, F.substring("source", 1, 1), weights, budget=budget, max_epochs=2, seed=3).collect())
        assert got == brute(docs, weight, budget, 2, 3), budget


def test_shortages_at_every_level_lose_no_budget(spark):
    """What is given equals the budget or all that may be drawn, but for one token a division."""
    docs = [(i, " ".join("x" * n), lang, source) for i, (n, lang, source) in enumerate([(100, "x", "A1"), (10, "x", "A2"), (100, "x", "B1"), (40, "y", "B1"), (3, "z", "B2")])]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    weights = {("*", "*", "A1"): 0, ("B", "y"): 0}
    for budget in (20, 100, 113, 500):
        plan = plan_budgets(frame.select(F.substring("source", 1, 1).alias("domain"), "lang", "source", F.size(F.split("text", " ")).cast("long").alias("tokens"), F.lit(1).alias("rows")), weights, budget, 1)
        given = {r.source + r.lang: r.given for r in plan.collect()}
        assert given.keys() == {"A2x", "B1x", "B2z"}
        assert min(budget, 113) - 2 <= sum(given.values()) <= min(budget, 113), given
        if budget >= 100:
            assert given["A2x"] == 10 and given["B1x"] >= budget - 10 - 3 - 2 - (budget - 113 if budget > 113 else 0)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, tokens int")
    assert mix_sources(frame, F.lit("d"), {}, share=0.5).count() == 0


def test_weight_zero_holds_nothing(spark):
    """What only a leaf of weight 0 holds is no reason to give its parents a budget: it goes to their siblings."""
    docs = [(i, " ".join("x" * 10), lang, source) for i, (lang, source) in enumerate([("en", "a1"), ("en", "a0"), ("de", "a1"), ("xx", "a1"), ("en", "b1")] * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    for weights, expected in (
        ({("b",): 0, ("*", "*", "a0"): 0, ("*", "en"): 9, ("*", "xx"): 0}, {("en", "a1"): 400, ("de", "a1"): 300}),
        ({("a",): 9, ("*", "*", "a1"): 0}, {("en", "a0"): 400, ("en", "b1"): 300}),
    ):
        given = {}
        for r in mix_sources(frame, F.substring("source", 1, 1), weights, budget=700, max_epochs=2, seed=1).collect():
            given[r.lang, r.source] = given.get((r.lang, r.source), 0) + r.n_tokens
        assert given == expected
