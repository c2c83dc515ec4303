"""Variant spellings of names typed by people, linked by shared canonical rewritings.

Every distinct (name, e-mail) is rewritten by rules into all the forms it may stand for: nicknames
resolved, token order restored, initials, middle names and legal forms dropped, abbreviations written
out, accents folded, logins squashed, and one-letter slips turned into forms that both spellings
share. Forms are exploded and equi-joined: rows that share a form meet in a hub, no pair is compared.

A *strong* form (full name, personal mailbox, company name) links what shares it. A slip is refused
where two spellings are both confirmed by mailboxes of their own. A *weak* form (initial and surname,
login) is scored by its rarity, 1 / number of different people known by a full name that have it, and
links only above 1/2, so that relatives who share a surname stay apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.components import components
from lodeweave.runtime import cut, parallelism, ship

# Nicknames by full name.
NICKNAMES = {
    "alexander": "alex sasha sascha xander sandy", "antonio": "toni tony", "benjamin": "ben benny", "christina": "chris tina christy", "christopher": "topher kit",
    "daniel": "dan danny", "dmitri": "dima mitya", "edward": "ed eddie ned", "elizabeth": "beth betty eliza lisa liz lizzy", "francesca": "fran cesca franzi",
    "gabriela": "gabi gaby", "jakub": "kuba", "johannes": "jo hannes hans", "jonathan": "jon jonny", "josephine": "josie josy", "katherine": "kate kathy katie kitty",
    "leonard": "leo len lenny", "lucia": "lucy", "margaret": "maggie meg peggy", "matthias": "matt hias", "maximilian": "max", "michael": "mike mick mikey",
    "miriam": "miri", "nicholas": "nick nico", "olga": "olya", "patricia": "pat trish patty", "richard": "dick rick rich", "robert": "bob rob bobby robbie",
    "samuel": "sam sammy", "stephanie": "steffi steph", "susanne": "sanne susi suse", "theodore": "ted theo teddy", "thomas": "tom tommy", "victoria": "vicky vic",
    "william": "bill will billy willy", "nadia": "nadja", "oskar": "ossi", "esther": "essie", "ingrid": "inga", "annika": "anni", "irene": "irina", "joseph": "joe", "james": "jim jimmy", "john": "jack", "andrew": "andy drew", "anthony": "ant", "charles": "charlie chuck", "henry": "harry hank", "peter": "pete", "steven": "steve", "jennifer": "jen jenny", "rebecca": "becky", "deborah": "deb debbie", "susan": "sue suzy",
}
# Company words by the abbreviations used for them.
COMPANY_WORDS = {
    "technologies": "technologies technology tech techn", "systems": "systems system sys", "consulting": "consulting cons consult", "software": "software sw soft",
    "laboratories": "laboratories laboratory labs lab", "international": "international intl int", "services": "services svc svcs", "solutions": "solutions", "engineering": "engineering eng", "industries": "industries ind", "foundation": "foundation", "associates": "associates assoc", "university": "university univ", "group": "group grp",
}
# Legal forms, and mailboxes that belong to nobody in particular.
LEGAL_FORMS = set("inc incorporated gmbh ltd limited ag bv sa sarl llc llp plc corp corporation co kg se nv oy ab as spa srl pty".split())
SHARED_MAILBOXES = set("root info dev oss builds build devops admin administrator ci cd git deploy team contact hello office support release releases noreply no-reply postmaster webmaster jenkins bot robot buildbot mail user nobody test service engineering security ops it hr sales help helpdesk".split())

#: Forms shorter than this have no slips: one letter less or more and they are another name.
LEAST_SLIP = 6

_FULL_OF = {n: full for full, nicks in NICKNAMES.items() for n in nicks.split()}
_COMPANY_OF = {a: word for word, abbr in COMPANY_WORDS.items() for a in abbr.split()}


def fold(s: str) -> str:
    """Lower case without accents; sharp s and the like written out."""
    s = s.casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _letters(s: str) -> str:
    return "".join(c for c in s if c.isalpha())


def parse_name(name: str | None) -> dict:
    """What a typed name says: kind 'person', 'initial', 'login', 'company' or 'none', and its parts."""
    s = fold(name or "")
    s = re.sub(r"\(.*?\)|\[.*?\]", " ", s)
    s = re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", s)  # s.a. -> sa.
    slug = not re.search(r"\s", s.strip())
    tokens = [t for t in re.split(r"[^\w'’-]+|_" if not slug else r"[^\w]+|_", s) if t]
    if slug and len(tokens) == 1 or not tokens:
        return {"kind": "login", "login": _letters(tokens[0])} if tokens and _letters(tokens[0]) else {"kind": "none"}
    bare = [t for t in tokens if t not in LEGAL_FORMS]
    if len(bare) < len(tokens) and bare or any(t in _COMPANY_OF for t in bare[1:]) or (bare[0] == "the" and bare[-1] == "team"):
        core = [_COMPANY_OF.get(t, t) for t in bare if t not in ("the", "team")]
        return {"kind": "company", "core": core} if core else {"kind": "none"}
    if "," in s and not slug:
        last, _, first = s.partition(",")
        tokens = [t for t in re.split(r"[^\w'’-]+|_", first + " " + last) if t]
    else:
        last = ""
    if len(tokens) < 2:
        return {"kind": "login", "login": _letters(tokens[0])} if tokens and _letters(tokens[0]) else {"kind": "none"}
    first, family, middle = tokens[0], tokens[-1], [t for t in tokens[1:-1] if len(t) > 1]
    parts = [_letters(p) for p in family.split("-") if _letters(p)] or [_letters(family)]
    first = _letters(first)
    if not first or not parts[0] or len(parts[0]) < 2:
        return {"kind": "none"}
    return {"kind": "person" if len(first) > 1 else "initial", "first": first, "family": parts, "middle": _letters("".join(middle))}


def parse_email(email: str | None) -> dict:
    """Mailbox without tags: local, domain, login (letters only), shared, hidden (an alias of a code host)."""
    s = re.sub(r"\s", "", fold(email or ""))
    if s.count("@") != 1:
        return {}
    local, domain = s.split("@")
    hidden = "noreply" in domain
    if hidden:
        local = re.sub(r"^\d+\+", "", local)
    local = re.sub(r"\+.*", "", local)
    plain = re.sub(r"[._-]", "", local)
    return {"local": plain, "domain": domain, "login": _letters(plain), "shared": local in SHARED_MAILBOXES or not _letters(plain), "hidden": hidden}


def logins_of(p: dict) -> list[str]:
    """The logins a person's name is usually turned into."""
    out = []
    for f in dict.fromkeys([p["first"], _FULL_OF.get(p["first"], p["first"])]):
        for fam in p["family"]:
            for head in (f, f[0]) if len(f) > 1 else (f,):
                out += [head + fam] + ([head + fam + p["middle"], head + p["middle"] + fam] if p["middle"] else [])
            if len(f) > 1:
                out += [fam + f, fam + f[0], f]
    return list(dict.fromkeys(out))


def slips(s: str) -> list[tuple[str, int]]:
    """(form, position): forms that two spellings share exactly if one letter is missing, added, replaced or swapped with the next."""
    out = [(f"d:{s}", 0)]
    for i in range(len(s)):
        rest = s[:i] + s[i + 1 :]
        out += [(f"d:{rest}", i), (f"r{i}:{rest}", i)]
        if i + 1 < len(s):
            pair = "".join(sorted(s[i : i + 2]))
            out.append((f"t{i}:{s[:i]}{pair}{s[i + 2 :]}", i))
    return out


def _confirmed(p: dict, login: str) -> int:
    """2 if the login spells first and family name as typed, 1 if the family name only, else 0."""
    tails = {"", p["middle"]}
    for fam in p["family"]:
        if any(login in (p["first"] + fam + t, p["first"] + t + fam, fam + p["first"]) for t in tails) and len(p["first"]) > 1:
            return 2
        if any(login in (p["first"][0] + fam + t, p["first"][0] + t + fam) for t in tails):
            return 1
    return 0


def rewrite(name: str | None, email: str | None) -> list[tuple[str, str, int]]:
    """All forms of one (name, e-mail): (form, rule, how far the mailbox confirms the spelling).

    Rules: 'full' and 'mailbox' and 'company' are strong and may have slips; 'initial', 'login' and
    'domain' are weak. Null, empty and blank fields give no forms.
    """
    p, e, out = parse_name(name), parse_email(email), []
    personal = bool(e) and not e["shared"]
    confirmed, agrees = 0, False
    if p["kind"] in ("person", "initial"):
        mine = logins_of(p)
        if personal:
            confirmed = _confirmed(p, e["login"])
            agrees = e["login"] in mine or max(SequenceMatcher(None, e["login"], m, autojunk=False).ratio() for m in mine) >= 0.6
        if p["kind"] == "person":
            for f in dict.fromkeys([p["first"], _FULL_OF.get(p["first"], p["first"])]):
                out += [(f"{f}|{fam}", "full", confirmed) for fam in p["family"]]
        for f in dict.fromkeys([p["first"][0], _FULL_OF.get(p["first"], p["first"])[0]]):
            out += [(f"{f}|{fam}", "initial", confirmed) for fam in p["family"]]
        out += [(m, "login", confirmed) for m in mine if len(m) > 3 and m not in (p["first"],)]
    elif p["kind"] == "company":
        core = p["core"]
        if e:
            confirmed = 2 * (_letters(e["domain"].split(".")[0]) in (core[0], "".join(core)))
            if confirmed or SequenceMatcher(None, e["domain"].split(".")[0], core[0], autojunk=False).ratio() >= 0.75:
                out.append((e["domain"], "domain", 0))
        out.append((" ".join(core), "company", confirmed))
    elif p["kind"] == "login":
        out.append((p["login"], "login", 0))
        agrees = personal and SequenceMatcher(None, e["login"], p["login"], autojunk=False).ratio() >= 0.6
        confirmed = 2 * (personal and e["login"] == p["login"])
    elif e:
        agrees = personal
        if e["shared"]:
            out.append((e["domain"], "domain", 0))
    if personal and agrees:
        out += [(e["login"], "login", confirmed)]
        if not e["hidden"]:
            out.append((f"{e['local']}@{e['domain']}", "mailbox", confirmed))
    return out


def _short(s: str) -> str:
    """A long form by its digest: equal exactly if the forms are, and of bounded size."""
    return s if len(s) <= 64 else blake2b(s.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, *form) for i, n, m in zip(b["node"], b["name"], b["email"]) for form in dict.fromkeys(rewrite(n, m))]
        yield pd.DataFrame(rows, columns=["node", "form", "rule", "confirmed"])


def _slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for form, rule, ok in zip(b["form"], b["rule"], b["confirmed"]):
            moving, at, fixed = form.partition("@") if rule == "mailbox" else (form, "", "")
            if len(moving) >= LEAST_SLIP:
                head = moving.index("|") if rule == "full" else len(moving)  # a slip here needs the first name confirmed
                rows += [(form, rule, ok > (i < head), f"{rule}/{_short(s)}{at}{fixed}") for s, i in dict(slips(moving)).items()]
        yield pd.DataFrame(rows, columns=["form", "rule", "confirmed", "hub"])


def link_names(rows: DataFrame, id_col: str = "author_id", name_col: str = "author_name", email_col: str = "author_email", scored: bool = True) -> DataFrame:
    """(id, identity, score) for every row that says who it is: rows of one person or organisation share the identity.

    ``score`` is the rarity of the rarest form that the row shares with other rows: 1 for a full name, a mailbox or a
    company's name, 1 / number of people known by the form for an initial or login; null for a row on its own.

    Exactly repeated rows share one node, so copies cost nothing. Rows with neither a usable name nor
    a usable mailbox, and rows whose id is null, have no result row. Ties cannot arise: an identity is
    named by its least id. Extra columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    r = rows.select(F.col(id_col).cast("bigint").alias("id"), clean(name_col).alias("name"), clean(email_col).alias("email")).where("id is not null and (name is not null or email is not null)")
    nodes = r.groupBy("name", "email").agg(F.min("id").alias("node"), (F.max("id") > F.min("id")).alias("repeated"))
    parts = parallelism(spark, 1)
    forms = cut(nodes.repartition(parts, "node").mapInPandas(_forms, "node bigint, form string, rule string, confirmed int"))

    strong = forms.where("rule in ('full', 'mailbox', 'company')")
    spelled = strong.groupBy("form", "rule").agg(F.max("confirmed").alias("confirmed"))
    slip = cut(spelled.repartition(parts, "form").mapInPandas(_slips, "form string, rule string, confirmed boolean, hub string"))
    # a slip links spellings of which at most one has a mailbox of its own
    good = slip.groupBy("hub").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("n_confirmed")).where("n > 1 and n_confirmed < 2").select("hub")
    slipped = slip.join(good, "hub", "left_semi")
    hubs = strong.select("node", F.concat_ws("/", F.lit("="), "rule", "form").alias("hub")).unionByName(
        slipped.join(strong.select("node", "form", "rule").distinct(), ["form", "rule"]).select("node", "hub")
    )
    first = components(hubs)
    known = forms.select("node").distinct().join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    named = forms.where("rule in ('full', 'company')").select("node").distinct().withColumn("named", F.lit(True))
    by_full_name = known.join(named, "node").select("component", "named").distinct()
    known = cut(known.join(by_full_name, "component", "left").select("node", "component", F.coalesce("named", F.lit(False)).alias("named")))

    weak = forms.where("rule in ('initial', 'login', 'domain')").select("node", F.concat_ws("/", "rule", "form").alias("hub"))
    met = weak.join(known, "node").select("hub", "component", "named").distinct()
    rare = met.groupBy("hub").agg((1 / F.greatest(F.lit(1), F.count_if("named"))).alias("score"), F.count_if("named").alias("n_named"), F.count("*").alias("n"))
    rare = rare.where("score > 0.5 and n > 1 and (n_named = 1 or hub not like 'domain/%')")
    # identities = components of components: a component is a hub of its nodes, a rare form a hub of components
    second = components(met.join(rare.select("hub"), "hub", "left_semi").select(F.col("component").alias("node"), "hub"))
    final = known.join(second.select(F.col("node").alias("component"), F.col("component").alias("identity")), "component", "left").select("node", F.coalesce("identity", "component").alias("identity"))
    named_rows = r.join(nodes, (r["name"].eqNullSafe(nodes["name"])) & (r["email"].eqNullSafe(nodes["email"]))).select("id", "node", "repeated")
    met_strong = hubs.groupBy("hub").agg(F.count_distinct("node").alias("n")).where("n > 1").select("hub")
    shared = hubs.join(met_strong, "hub", "left_semi").select("node", F.lit(1.0).alias("score")).unionByName(weak.join(rare.select("hub", "score"), "hub").select("node", F.col("score").cast("double")))
    best = shared.groupBy("node").agg(F.max("score").alias("best"))
    out = named_rows.join(final, "node")
    if not scored:
        return out.select("id", "identity").distinct()
    return out.join(best, "node", "left").select("id", "identity", F.when(F.col("repeated"), 1.0).otherwise(F.col("best")).alias("score")).distinct()


def pairs(linked: DataFrame) -> DataFrame:
    """Every pair of rows of one identity, the smaller id first (the form the query asks for)."""
    a = linked.select("identity", F.col("id").alias("author_id_a"))
    b = linked.select("identity", F.col("id").alias("author_id_b"))
    return a.join(b, "identity").where("author_id_a < author_id_b").select("author_id_a", "author_id_b")
