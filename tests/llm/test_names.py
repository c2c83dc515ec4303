import pytest

from lodeweave.llm import names

SCHEMA = "author_id bigint, author_name string, author_email string, identity string"


def linked(spark, rows):
    got = names.link_names(spark.createDataFrame([(i, n, e, "clash") for i, n, e in rows], SCHEMA)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["identity"], set()).add(r["id"])
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("a, b", [("Miller, Robert", "Bob Miller"), ("ROBERT J. MILLER", "Robert Miller (ext)"), ("Robert Müller-Smith", "robert muller"), ("Roebrt Miller", "Robert Miller"), ("Robert Milller", "Robert Miller"), ("Robrt Miller", "Robert Miller"), ("Robert Milxer", "Robert Miller"), ("Acme Tech Inc.", "acme-technologies"), ("The Acme Labs Team", "ACME LABORATORIES, S.A.")])
def test_variants_share_a_form(a, b):
    def forms(n):
        out = set()
        for f, rule, _ in names.rewrite(n, None):
            if rule in ("full", "company"):
                out |= {f"{rule}/{s}" for s, _ in names.slips(f)} | {f}
        return out

    assert forms(a) & forms(b)


@pytest.mark.parametrize("a, b", [("Robert Miller", "Ronald Miller"), ("Robert Miller", "Robert Mixxer"), ("Acme Systems", "Acme Software")])
def test_others_do_not(a, b):
    def forms(n):
        return {f"{r}/{s}" for f, r, _ in names.rewrite(n, None) if r in ("full", "company") for s, _ in names.slips(f)}

    assert not forms(a) & forms(b)


def test_links(spark):
    rows = [
        (1, "Robert Miller", "rmiller@x.example"), (2, "Bob Miller", None), (3, "R. Miller", "rmiller+git@x.example"), (4, "Miller, R.", None), (5, None, "17+rmiller@users.noreply.h.example"),
        (6, "Ruth Zander", "ruth.zander@x.example"), (7, "Ralf Zander", "ralf.zander@x.example"), (8, "Zander, R.", None), (9, "Ruth Zander", "root@x.example"), (10, "Ina Kopp", "root@x.example"),
        (11, None, None), (12, "", "  "), (13, "Robert Miller", "rmiller@x.example"), (None, "Robert Miller", None),
    ]
    assert linked(spark, rows) == [[1, 2, 3, 4, 5, 13], [6, 9], [7], [8], [10]]


def test_confirmed_spellings_stay_apart(spark):
    rows = [(1, "Anna Kolar", "anna.kolar@x.example"), (2, "Anna Kolas", "anna.kolas@x.example"), (3, "Anna Kolar", None)]
    assert linked(spark, rows) == [[1, 3], [2]]


def test_empty_and_long(spark):
    assert linked(spark, []) == []
    assert linked(spark, [(1, "x" * 3000 + " yz", None), (2, "x" * 3000 + " yz", None), (3, "x" * 2999 + " yz", None)]) == [[1, 2, 3]]


def test_pairs(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id bigint, identity bigint")
    assert sorted((r[0], r[1]) for r in names.pairs(df).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_scores_tell_how_rare_the_shared_form_is(spark):
    rows = [(1, "Robert Miller", None), (2, "Bob Miller", None), (3, "R. Miller", None), (6, "Ruth Zander", None), (9, "Ina Kopp", "x@y.example"), (10, "Ina Kopp", "x@y.example")]
    got = {r["id"]: (r["identity"], r["score"]) for r in names.link_names(spark.createDataFrame(rows, "author_id bigint, author_name string, author_email string")).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 1.0), 6: (6, None), 9: (9, 1.0), 10: (9, 1.0)}
