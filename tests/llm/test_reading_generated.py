import random

import numpy as np

from lodeweave.llm import generated, reading, trees

EASY = ["Open the page.", "Click the box and wait.", "Now you are done!", "You see a list."]
HARD = ["Notwithstanding the idempotence of upserts, convergence presupposes a total order that persistence does not guarantee.", "Bisimilarity subsumes congruence, a ramification whose significance has been systematically underestimated."]


def test_trees_learn_and_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    assert ((trees.random_forest(x, y, n_trees=20).predict(x) > 0.5) == y).mean() > 0.93
    assert np.abs(trees.boosted(x, x[:, 0] ** 2, rounds=80).predict(x) - x[:, 0] ** 2).mean() < 0.3
    knots, fit = trees.isotonic(x[:, 0], x[:, 0] + rng.normal(size=600))
    assert (np.diff(fit) >= -1e-12).all() and (np.diff(knots) >= 0).all()
    assert trees.boosted(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0, 0]


def documents(spark):
    r = random.Random(3)
    rows = []
    for i in range(160):
        level = 4 if i % 2 else 1
        rows.append((i, " ".join(r.choice(HARD if level == 4 else EASY) for _ in range(6)), f"s{i % 4}", "x"))
    rows += [(900, None, "s1", "x"), (901, "", None, "x"), (902, " \n ", "s1", "x"), (903, "```\ncode\n```", "s1", "x"), (904, "Wort " * 30_000, "s1", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, level string")


def test_reading_level_on_held_out(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, 4 if i % 2 else 1, "r") for i in range(0, 100)] + [(1, 3, "q"), (None, 4, "q"), (5, None, "q"), (7777, 4, "q")], "doc_id bigint, reading_level int, rater string")
    model = reading.fit(docs, labels)
    got = {r["doc_id"]: r for r in reading.grade(docs, model).collect()}
    assert len(got) == 165
    held = [i for i in range(100, 160)]
    assert np.mean([got[i]["is_expert"] == bool(i % 2) for i in held]) >= 0.95
    assert all(got[i]["grade"] is None and got[i]["is_expert"] is None for i in (900, 901, 902))
    assert got[903]["grade"] is not None and not got[904]["is_expert"]
    assert reading.grade(docs.limit(0), model).count() == 0 and model.report["n"].sum() == 100


def test_reading_without_labels(spark):
    docs = documents(spark).limit(4)
    model = reading.fit(docs, spark.createDataFrame([], "doc_id bigint, reading_level int"))
    assert reading.grade(docs, model).where("is_expert").count() == 0


LINES = "array<struct<line_no int, line_text string, line_type string>>"


def test_generated_files(spark):
    r = random.Random(5)
    words = "account order parcel ledger review tariff".split()

    def hand():
        return [f"def {r.choice(words)}_{r.choice(words)}(self, {r.choice(words)}):", "    # checks the input", f"    if not {r.choice(words)}:", f'        raise ValueError("{r.choice(words)} is missing")', f"    return self.{r.choice(words)}.get({r.choice(words)})", ""] * 4

    def made():
        return [f"_F{i:03d} = _d.Field(name='{r.choice(words)}', number={i}, kind=1)" for i in range(25)]

    rows, want = [], set()
    for i in range(150):
        if i % 3 == 0:
            body = made()
            body = (["# Code generated by tool 1.2. DO NOT EDIT."] if i % 2 else []) + body
            want.add(i)
        else:
            body = (["# written by hand after the generated version was dropped"] if i % 7 == 0 else []) + hand()
        rows.append((i, f"r{i % 9}", f"src/f{i}.py", [(k + 1, s, "") for k, s in enumerate(body)], "z"))
    blob = [(k + 1, '    "' + "Ab3/" * 15 + '"', "") for k in range(30)]
    bundle = lambda n: "".join(f"var {r.choice('abcdxyz')}{k}=[{r.randrange(99)}];" for k in range(n))
    rows += [(300 + i, "r1", f"web/{i}.js", [(1, bundle(80 + i), "")] + [(2, "//# sourceMappingURL=x.js.map", "")] * (i % 2), "z") for i in range(30)]
    rows += [(500, "r1", "a.js", [(1, bundle(100), "")], "z"), (501, "r1", None, blob, "z"), (502, None, "x.py", None, "z"), (503, "r1", "x.py", [], "z"), (504, "r1", "y.py", [(1, "# Code generated by tool 1.2. DO NOT EDIT.", "")], "z"), (505, "r1", "z.py", [(1, "# notes", "")], "z")]
    copies = [hand() for _ in range(12)]  # libraries in ten repositories each, every other with a notice
    rows += [(600 + 10 * n + k, f"q{k}", f"lib/c{n}.py", [(j, s, "") for j, s in enumerate((["# vendored from upstream c at 1.2"] if n % 2 else []) + c, 1)], "z") for n, c in enumerate(copies) for k in range(10)]
    df = spark.createDataFrame(rows, f"file_id bigint, repo string, relpath string, code_lines {LINES}, labelled string")
    got = {x["file_id"]: x["is_generated"] for x in generated.find_generated(df).collect()}
    wrong = {i for i in range(150) if got[i]} ^ want
    assert len(wrong) <= 6, wrong  # of which half carry no notice
    assert got[500] and got[501] and got[504] and not got[503] and not got[505] and 502 not in got
    assert sum(got[300 + i] for i in range(30)) >= 28 and sum(got[600 + i] for i in range(120)) >= 100
    assert generated.find_generated(df.limit(0)).count() == 0


def test_the_forest_is_fitted_on_all_bodies(spark):
    """Four libraries of sixty files each among 3,000 bodies of one file: no bounded sample of the bodies has them all."""
    rng, at = np.random.default_rng(4), generated.FEATURES.index("log_owners")
    rows = [(i, i % 50 == 0, f"{i * 7919 % 3000:05d}", [float(v) + 3 * (i % 50 == 0) for v in rng.normal(size=len(generated.FEATURES))]) for i in range(3000)]
    for r in rows:
        r[3][at] = 0.0
    shared = [(10_000 + 100 * n + k, True, f"z{n}", [float(np.log(60)) if j == at else 0.0 for j in range(len(generated.FEATURES))]) for n in range(4) for k in range(60)]
    described = spark.createDataFrame(rows + shared, "file_id bigint, labelled boolean, body string, x array<double>")
    model = generated.fit(described, 500)
    assert (model.predict(np.array([s[3] for s in shared[::60]])) >= 0.5).all()
    hand = np.array([r[3] for r in rows if not r[1]])
    assert (model.predict(hand) >= 0.5).mean() < 0.02


def test_joined_forests_are_the_mean_of_their_trees():
    x = np.random.default_rng(2).normal(size=(400, 5))
    a, b = (trees.random_forest(x[k::2], x[k::2, 0] > 0.2, n_trees=7, seed=k) for k in (0, 1))
    assert np.allclose(trees.Forests([a, b]).predict(x), (a.predict(x) + b.predict(x)) / 2)


def test_notices_anywhere():
    code = [f"def f{i}(a):" for i in range(60)]
    for notice in ("// end of output, Code generated by schemac 3.11. DO NOT EDIT.", "//# sourceMappingURL=a.js.map"):
        assert generated.body_of("\n".join([*code, notice])) == (True, code)
    bundle = "var a=b(1);" * 200
    assert generated.body_of(bundle + "//# sourceMappingURL=a.js.map") == (True, [bundle])
    assert generated.body_of(f"{bundle}/* generated by pack v2 */{bundle}") == (True, [bundle + bundle])
    assert generated.body_of("\n".join([*code, "# written by hand, not generated by tool 1.2"]))[0] is False


def test_literal_share_at_every_size():
    code = [f"    total = order.price(item_{i}, rate) * self.factor(item_{i})" for i in range(40_000)]
    assert sum(map(len, code)) > 2_000_000 and generated.literal_share(code) == 0
    rows = [f"    {i}, 0x1F, 'a b', true," for i in range(100_000)]
    assert sum(map(len, rows)) > 2_000_000 and generated.literal_share(rows) == 1
    assert not generated.is_literal("1" * 100_000 + "x") and generated.is_literal("(" + "1, " * 100_000 + "1)")
    assert generated.is_literal("INSERT INTO a (b) VALUES (1, 'it''s');") and not generated.is_literal("x = VALUES(1)")
