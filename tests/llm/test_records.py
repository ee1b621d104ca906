"""Entity, address, component, name and survivor operators on small tables, against brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Row

from siltstone.llm import addresses, contacts, names, p1_entities, p2_addresses, p3_components, p5_names, p6_survivor
from siltstone.llm.strings import edits

CITIES = [(1, "Selsor", "S", "SS", "Sundria", "578", None), (2, "Dormar", "F", "FH", "Sundria", "329", "Old Dormar"), (3, "North Daton", "K", "KD", "Norvale", "121", None)]
NICKS = [("Edward", "Ed"), ("Katherine", "Kate")]
PARTS = "struct<customer_id:string,name:string,phone:string,email:string,address:string>"
SCHEMA = f"rec_id bigint, cleaned_record {PARTS}, original_record {PARTS}, metadata struct<source:string,channel:string,file_row:bigint>, timestamp timestamp, k string, v string, root bigint"


def customers(spark, rows):
    out = []
    for i, (rid, src, cid, n, p, e, a) in enumerate(rows):
        r = Row(customer_id=cid, name=n, phone=p, email=e, address=a)
        out.append((rid, r, r, Row(source=src, channel="agent" if i % 2 else "ocr", file_row=i), dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "clash", None, 7))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(CITIES, "city_id bigint, city string, state string, state_code string, country string, postal_prefix string, also_known_as string")


@pytest.fixture(scope="module")
def nicks(spark):
    return spark.createDataFrame(NICKS, "given_name string, nickname string")


ROWS = [
    (1, "a", "A1", "Edward Morlun", "+919876543210", "edward.morlun1ab2@x.test", "12 Tolin Road, Selsor 578123"),
    (2, "b", "B7", "Ed Morlun", "09876543210", None, "12, Tolin Rd., Selsor"),
    (3, "c", "C9", "Morlun, Edward", None, "edward.morlun1ab2+shop@y.test", None),
    (4, "b", "B8", "Susan Morlun", "9876543210", "susan1zz9@x.test", "12 Tolin Road, Selsor"),  # household
    (5, "c", "C2", "Edward Morlun Jr", "9876543210", "ejr2kk2@x.test", "12 Tolin Road, Selsor"),  # son
    (6, "a", None, None, None, "edward.morlun1ab2@x.test", "n/a"),
    (7, "d", "N/A", "Edward Morlun", "missing", "-", ""),  # nothing to go by
    (8, "a", "A1", "Edward Morlun", "+919876543210", "edward.morlun1ab2@x.test", "12 Tolin Road, Selsor 578123"),  # exact copy
    (9, "b", "", "Garanel Hdwe Pvt Ltd", "7012345678", None, None),
    (10, "c", "G", "Garanel Hardware Limited", "7012345678", None, "x" * 30_000),
]


def pairs(df):
    return {(r[0], r[1]) for r in df.collect()}


def test_entities(spark, cities, nicks):
    got = p1_entities.match_entities(customers(spark, ROWS), cities, nicks)
    found = pairs(got)
    assert {(1, 2), (1, 3), (2, 8), (3, 8), (3, 6), (9, 10)} <= found
    assert not {p for p in found if 4 in p or 5 in p or 7 in p}
    assert not found & {(1, 6), (1, 8)}  # of one source
    assert all(a < b for a, b in found) and got.count() == len(found)
    assert all(r.confidence is None or 0 <= r.confidence <= 1 for r in got.collect())


def test_entities_of_nothing(spark, cities, nicks):
    assert p1_entities.match_entities(customers(spark, []), cities, nicks).count() == 0


def test_hamming_is_exact(spark):
    r = random.Random(5)
    vs = [sorted(r.sample(range(p1_entities.BITS), r.randrange(4, 14))) for _ in range(60)]
    for v in vs[:60]:  # up to three bits out, up to three others in
        w = set(v) - set(r.sample(v, min(len(v) - 1, r.randrange(4)))) | set(r.sample(range(40), r.randrange(4)))
        vs.append(sorted(w))
    vs = [v for v in vs if len(v) > p1_entities.RADIUS]
    df = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(vs)], "w string, v array<short>")
    near = lambda x, y: max(len(set(x) - set(y)), len(set(y) - set(x))) <= p1_entities.RADIUS
    brute = {(f"{i:04d}", f"{j:04d}") for i, j in itertools.combinations(range(len(vs)), 2) if near(vs[i], vs[j])}
    assert pairs(p1_entities.near_values(df)) == brute and len(brute) > 30


@pytest.mark.parametrize("seed", range(2))
def test_one_error_is_within_the_radius(seed):
    r = random.Random(seed)
    for _ in range(500):
        w = "".join(r.choice("abcdef123.") for _ in range(r.randrange(7, 16)))
        i = r.randrange(len(w) - 1)
        others = [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]]
        d = "".join(r.choice("0123456789") for _ in range(10))
        k = r.randrange(9)
        near = [(p1_entities.vector("e", [w]), p1_entities.vector("e", [o])) for o in others] + [(p1_entities.digits(d), p1_entities.digits(o)) for o in (d[:k] + d[k + 1] + d[k] + d[k + 2 :], d[:k] + "7" + d[k + 1 :])]
        assert all(max(len(set(x) - set(y)), len(set(y) - set(x))) <= p1_entities.RADIUS for x, y in near)


def test_confidence_is_calibrated():
    r = np.random.default_rng(4)
    true = r.random(40_000) < 0.3
    at = lambda p, q: np.where(true, r.choice(6, 40_000, p=p), r.choice(6, 40_000, p=q))
    levels = np.stack([at([0, 0.02, 0.03, 0.1, 0.15, 0.7], [0, 0.2, 0.5, 0.2, 0.05, 0.05]), at([0.4, 0.05, 0, 0, 0.05, 0.5], [0.4, 0.5, 0.05, 0, 0, 0.05]), at([0.3, 0.05, 0, 0, 0.05, 0.6], [0.3, 0.3, 0, 0, 0, 0.4]), at([0.3, 0.1, 0.1, 0.1, 0.1, 0.3], [0.3, 0.3, 0.2, 0.1, 0.05, 0.05])])
    ok = np.where(true, r.random(40_000) < 0.95, r.random(40_000) < 0.04)
    keys = [(int(p), bool(o)) for p, o in zip(levels.T @ np.array([216, 36, 6, 1]), ok)]
    counts = {}
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    fitted = p1_entities.fit_confidence(counts)
    c = np.array([fitted[k] for k in keys])
    for lo in np.arange(0, 1, 0.1):
        m = (c >= lo) & (c < lo + 0.1)
        assert m.sum() < 300 or abs(c[m].mean() - true[m].mean()) < 0.08
    assert p1_entities.fit_confidence({}) == {}


def test_entities_by_misspelt_street(spark, cities, nicks):
    at = ["28 Fenmaomnt Square, Selsor", "28 Fenmamopnt Square, Selsor", "28 Fenmaomnt Square, Dormar", "29 Fenmaomnt Square, Selsor"]
    rows = [(i + 1, "abcd"[i], None, "Asha Wafen", None, None, a) for i, a in enumerate(at)]
    rows += [(5, "a", None, "Edward Morlun", "9876543210", None, None), (6, "b", None, "Edward Morlun", "9876534210", None, None)]  # swapped digits
    assert pairs(p1_entities.match_entities(customers(spark, rows), cities, nicks)) == {(1, 2), (5, 6)}


def test_entities_without_name_key(spark, cities, nicks):
    rows = [
        (1, "a", None, "F. Tbaper", None, "ftaper102x@x.test", None), (2, "b", None, "Friedrich Taper", None, "ftaper102x@y.test", None),  # one mailbox
        (3, "a", None, "Betty Bemar", "9539069090", None, None), (4, "b", None, "Elizabeth Bepar", "9539069090", None, None),  # one phone
        (5, "a", None, "J Saidor", "9263172151", "jsaidor9k2@x.test", None), (6, "b", None, "Johannes Satidor", "9263172511", "jsaidro9k2@x.test", None),  # both with an error
    ]
    assert pairs(p1_entities.match_entities(customers(spark, rows), cities, nicks)) == {(1, 2), (3, 4), (5, 6)}


def test_every_pair_has_a_confidence(spark, cities, nicks):
    rows = [
        (1, "a", None, "Edward Morlun", "9876543210", None, None), (2, "b", None, "Edward Morlun", "9876543210", "edward.morlun1ab2@x.test", None),
        (3, "c", None, "Edward Morlun", None, "edward.morlun1ab2@x.test", None),  # tied to 1 by way of 2
        (4, "d", None, None, None, "edward.morlun1ab2@x.test", None),  # has no field in common with 1
    ]
    got = {(r.rec_a, r.rec_b): r.confidence for r in p1_entities.match_entities(customers(spark, rows), cities, nicks).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert all(c is not None and 0 < c <= 1 for c in got.values())


def test_same_address(spark, cities):
    texts = ["12 Tolin Road, Selsor 578123", "Selsor; #12 Tolin Rd.", "12, Tolni Road, Selsor", "12 Tolin Street, Selsor", "12 Tolin Road, Dormar", "Flat 3, 12 Tolin Road, Selsor", "12/3 Tolin Rd, Selsor", "12 N Tolin Road, Selsor", "n/a", None, "", "12 TOLIN, 578 123", "12 Tolin Road, Selsor 578123", "no digits here", "7 " * 20_000]
    rows = [(i + 1, "a", None, None, None, None, t) for i, t in enumerate(texts)]
    found = pairs(p2_addresses.match_addresses(customers(spark, rows), cities))
    towns = addresses.Gazetteer([(c[0], c[1], c[5], c[6]) for c in CITIES], ["Sundria", "SS"])
    kept = {i + 1: addresses.parse(t, towns) for i, t in enumerate(texts) if t and t != "n/a"}
    brute = {(a, b) for a, b in itertools.combinations(sorted(kept), 2) if addresses.same_place(kept[a], kept[b])}
    assert found == brute
    assert {(1, 2), (1, 3), (1, 13), (6, 7), (1, 12)} <= found and not {(1, 4), (1, 5), (1, 6), (1, 8)} & found
    assert pairs(p2_addresses.match_addresses(customers(spark, []), cities)) == set()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2080)]
    edges += edges[:10] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {row.v: row.root for row in p3_components.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    mine = {v: find(v) for v in list(parent)}
    assert got.keys() == mine.keys()
    assert len({(got[v], mine[v]) for v in mine}) == len(set(mine.values())) == len(set(got.values()))


def test_components_of_nothing(spark):
    assert p3_components.connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0
    assert p3_components.linked_groups(customers(spark, [(1, "a", None, None, "0000000000", None, None), (2, "a", "n/a", None, "0000000000", None, None)])).count() == 0


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("last", [0, 40, 200_000])
def test_components_end_in_one_task(spark, monkeypatch, last):
    """Chains of 1 to 60 vertices: whole whether levels or one task join what is left, and few jobs (the driver's memory) by the task."""
    monkeypatch.setattr(p3_components, "LAST", last)
    edges = [(1000 * k + i + 1, 1000 * k + i) for k in range(1, 61) for i in range(k)]
    got, n = jobs(spark, f"components {last}", lambda: p3_components.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect())
    assert sorted(r.v for r in got) == sorted({v for e in edges for v in e})
    assert len({(r.v // 1000, r.root) for r in got}) == len({r.root for r in got}) == 60
    assert n <= 30 or last < 200_000


def test_mailboxes_and_phones_are_searched_at_once(spark):
    rows = [(1, "abcdefg.one", "9876543210"), (2, "abcdefg.onx", "1234567899"), (3, "9876543210", "9876543201"), (4, "", "9876543210"), (5, "abcdefg.one", ""), (6, "abc", ""), (7, "abd", "")]
    rec = spark.createDataFrame([(i, e, p, p1_entities.vector("e", [e]) if e else [], p1_entities.digits(p)) for i, e, p in rows], "rec_id long, e string, p string, ve array<short>, vp array<short>")
    near, n = jobs(spark, "near", lambda: {(r.x, r.y) for r in p1_entities.near_pairs(rec).collect()})
    assert near == {(1, 2), (1, 5), (2, 5), (1, 4), (1, 3), (3, 4)}  # mailbox of 3 is no phone
    assert n <= 16


def test_linked_groups(spark):
    rows = [(4, "a", "cus-1", None, None, None, None), (2, "b", "CUS 1", None, "tel: 9876543210", None, None), (9, "c", None, None, "+91 98765 43210", None, None), (7, "c", "x", None, "12345", None, None)]
    assert {(r.rec_id, r.group_id) for r in p3_components.linked_groups(customers(spark, rows)).collect()} == {(4, 2), (2, 2), (9, 2)}


def test_survivors(spark):
    rows = [(5, "a", "A-1", "Old Name", None, "bad@", "x"), (3, "b", "a1", "Name", None, "a b@c.de", "N/A"), (8, "c", "A 1", "n/a", None, "ok@mail.test", ""), (9, "c", "solo", "S", None, None, None)]
    trust = spark.createDataFrame([("agent", 9), ("ocr", 1)], "channel string, trust long")
    got = {(r.group_id, r.field): (r.rec_id, r.value) for r in p6_survivor.survivors(customers(spark, rows), trust).collect()}
    assert got == {(3, "name"): (3, "Name"), (3, "email"): (8, "ok@mail.test"), (3, "address"): (5, "x")}
    assert p6_survivor.survivors(customers(spark, []), trust).count() == 0


@pytest.mark.parametrize("mail,ok", [("a@b.c", True), (" a@b.c ", True), ("a@b", False), ("@b.c", False), ("a@.c", False), ("a@b.", False), ("a@@b.c", False), ("a@b@c.d", False), ("a b@c.d", False), ("", False), (None, False), ("a@b.c.", False), ("a@b..c", True)])
def test_usable_email(spark, mail, ok):
    df = spark.createDataFrame([(mail,)], "e string")
    assert bool(df.select(p6_survivor.usable("email", df.e)).first()[0]) is ok


def test_fusion_discounts_copies(spark):
    rows = []
    for g in range(40):
        good = f"Person {g}"
        for s, v in (("a", good), ("b", good if g % 5 else "Odd A"), ("c", f"Wrong {g}" if g % 2 else good), ("d", f"Wrong {g}" if g % 2 else good), ("e", good if g % 3 else f"Odd E{g}"), ("f", good if g % 7 else f"Odd F{g}")):
            rows.append((g * 10 + len(rows) % 7 + 1000 * len(rows), s, f"K{g}", v, None, None, None))
    got = p6_survivor.fuse(customers(spark, rows)).filter("field = 'name'").collect()
    assert len(got) == 40 and sum(r.value.startswith("Person") for r in got) >= 36
    assert p6_survivor.fuse(customers(spark, [])).count() == 0


USERS = "row_id bigint, Name string, Email string, `Date of Birth` string, Phone string, Salary string, City string, canon string"


def test_names_link(spark, cities, nicks):
    users = spark.createDataFrame([(1, "MORLUN EDWARD", "edward.morlun1ab2@x.test", None, None, None, None, "c"), (2, "E Morlun", None, None, "9876543210", None, None, None), (3, "Ed Morlun", None, None, None, None, "Selsor", None), (4, "Garanel Hardware", None, None, "7012345678", None, None, None), (5, None, None, None, None, None, None, None), (6, "Susan Morlun", None, None, "98765-43210", None, None, None)], USERS)
    got = pairs(p5_names.link_names(users, customers(spark, ROWS), cities, nicks))
    assert {(1, 1), (1, 3), (1, 8), (2, 2), (3, 2), (4, 9), (4, 10), (6, 4)} <= got
    assert not {p for p in got if p[0] == 5} and not {(1, 4), (6, 1), (6, 2), (3, 4)} & got
    assert pairs(p5_names.link_names(users.limit(0), customers(spark, []), cities, nicks)) == set()


def test_names_link_by_misspelt_mailbox(spark, cities, nicks):
    user, customer = ["bebin2zl6", "ines16hq", "soren1qoy", "abcdefghij", "noor123"], ["bebni2zl6", "ine16hq", "sore1nqoy", "abcdfeghij", "noor12"]
    users = spark.createDataFrame([(i, "Noor Bebin", f"{e}@x.test", None, None, None, None, None) for i, e in enumerate(user)], USERS)
    held = customers(spark, [(10 + i, "a", None, "Noor Bebin", None, f"{e}@y.test", None) for i, e in enumerate(customer)])
    assert pairs(p5_names.link_names(users, held, cities, nicks)) == {(i, 10 + i) for i in range(len(user))}


def test_names_link_by_town_at_the_threshold(spark, cities, nicks):
    users = spark.createDataFrame([(1, "Sunita Elnar", None, None, None, None, "Selsor", None), (2, "Sunita Elnar", None, None, None, None, "Dormar", None)], USERS)
    held = customers(spark, [(11, "a", None, "SNUITA ELNAR", None, None, "12 Tolin Road, Selsor")])
    nick = names.Nicknames(NICKS)
    a, b = (p5_names.canonical(names.parse(x), nick) for x in ("Sunita Elnar", "SNUITA ELNAR"))
    canon = spark.createDataFrame([(x,) for x in (a, a, b)], "canon string")
    assert p5_names.THRESHOLD <= p5_names.Cosine(p5_names.trigram_weights(canon))(a, b) < 0.5
    assert pairs(p5_names.link_names(users, held, cities, nicks)) == {(1, 11)}


def test_names_link_through_their_group(spark, cities, nicks):
    users = spark.createDataFrame([(1, "Edward Morlun", "edward.morlun1ab2@x.test", None, None, None, None, None)], USERS)
    held = customers(spark, [
        (11, "a", "A1", "Ed Morlun", "9876543210", "edward.morlun1ab2@y.test", None), (12, "b", None, "Edward Morlun", "9876543210", None, None),  # by way of 11
        (13, "a", "A1", "E. Morlun", None, None, None), (14, "a", "A1", "Susan Halvek", None, None, None),  # one customer id, another name
        (15, "c", None, "Edward Morlun", "9876543210", "susan1zz9@x.test", None),
    ])
    assert pairs(p5_names.link_names(users, held, cities, nicks)) == {(1, 11), (1, 12), (1, 13), (1, 15)}


@pytest.mark.parametrize("cell", [1, 2, 4000])
def test_towns_in_cells(spark, cell):
    rows = [(i, f"Edward Morl{'aeiou'[i % 5]}n", f"edward morl{'aeiou'[i % 5]}n", "" if i % 3 else "x", "", "7" if i % 4 else "") for i in range(24)]
    schema = "id long, name string, canon string, e string, p string, t string"
    u, c = spark.createDataFrame(rows[:12], schema), spark.createDataFrame(rows[12:], schema)
    got = pairs(p5_names.town_links(u, c, names.Nicknames(NICKS), np.ones(p5_names.BUCKETS, np.float32), 0.25, cell))
    assert got == {(a[0], b[0]) for a in rows[:12] for b in rows[12:] if a[5] and b[5] and not (a[3] and b[3])}


def test_average_linkage_against_brute_force():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(14, 6))) * (r.random((14, 6)) < 0.5)
    x[x.sum(1) == 0, 0] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(14)]
    s = x @ x.T
    while len(groups) > 1:
        m, a, b = max((s[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if m < 0.5:
            break
        groups[a] += groups.pop(b)
    got = p5_names.average_linkage([(np.flatnonzero(v), v[v > 0]) for v in x], [1] * 14, 0.5)
    assert {frozenset(g) for g in groups} == {frozenset(i for i in range(14) if got[i] == k) for k in set(got)}


def test_names():
    nick = names.Nicknames([*names.COMMON, *NICKS])
    level = lambda a, b: names.compatible(names.parse(a), names.parse(b), nick)
    assert level("Dr. José Linlabin", "linlabin, jose") == names.STRONG
    assert level("BjörnHolnor", "Björn Holnor") == names.STRONG
    assert level("Kate Wilson Orper", "Katherine Orper") == names.STRONG
    assert level("E. Morlun", "Edward Morlun") == names.WEAK
    assert level("Edward Morlun", "Susan Morlun") <= names.SHARED
    assert level("Edward Morlun", "Edward Morlun Jr") <= names.SHARED
    assert level("Sorlaper Hdwe GmbH", "Sorlaper Hardware") == names.STRONG
    assert level("Sorlaper Hardware", "Sorlaper Foods Ltd") == names.NONE
    assert level("", "x") == names.NONE


def test_contacts_and_edits():
    assert contacts.mailbox(" <A.B+shop (at) x.test> ") == "a.b" and contacts.mailbox("nil") == "" and contacts.mailbox(None) == ""
    assert contacts.subscriber("0091-98765 43210") == "9876543210" and contacts.subscriber("1234567890") == "" and contacts.subscriber("8572750306.0") == "8572750306"
    assert edits("abcd", "abdc", 2) == 1 and edits("", "ab", 3) == 2 and edits("kitten", "sitting", 2) == 3


def test_fusion_beats_voting_where_sources_copy(spark):
    r = random.Random(11)
    rows, truth = [], {}
    for g in range(250):
        truth[g] = f"True {g}"
        said = {s: truth[g] if r.random() < a else f"False {g} {r.randrange(6)}" for s, a in (("a", 0.8), ("b", 0.75), ("c", 0.75), ("h", 0.7), ("d", 0.4))}
        said |= {s: said["d"] if r.random() < 0.95 else f"False {g} {r.randrange(6)}" for s in ("e", "f")}  # they copy d
        rows += [(g * 10 + k + 1, s, f"K{g}", v, None, None, None) for k, (s, v) in enumerate(said.items())]
    df = customers(spark, [x for x in rows])
    df = df.withColumn("metadata", df.metadata.withField("channel", df.metadata.source))
    right = lambda found: sum(found[g * 10 + 1].lower() == truth[g].lower() for g in truth) / len(truth)
    fused = right({x.group_id: x.value for x in p6_survivor.fuse(df).filter("field = 'name'").collect()})
    voted = right({x.group_id: x.value for x in p6_survivor.plain_vote(df).filter("field = 'name'").collect()})
    print(f"fused {fused:.3f} voted {voted:.3f}")
    assert fused >= 0.9 and fused >= voted + 0.1


def test_places_of_both_addresses(spark, cities):
    rows = [(i + 1, "a", None, None, None, None, t) for i, t in enumerate(["12 Tolin Road, Selsor 578123", "Selsor; #12 Tolin Rd.", "12, Tolni Road, Selsor", "12 Tolin Road, Dormar", None])]
    got = {(r.rec_id, r.field): r.place_id for r in p2_addresses.address_places(customers(spark, rows), cities).collect()}
    assert set(got) == {(i, f) for i in range(1, 5) for f in ("cleaned", "original")}
    assert len({got[(i, f)] for i in (1, 2, 3) for f in ("cleaned", "original")}) == 1 and got[(4, "cleaned")] == got[(4, "original")] != got[(1, "cleaned")]
    assert p2_addresses.address_places(customers(spark, []), cities).count() == 0


def test_screen_loses_no_name():
    nick = names.Nicknames(names.COMMON)
    r = random.Random(11)
    given, family = ["Robert", "Bobby", "Anna", "Ann", "Mohammed", "Md", "R", "Jo"], ["Grinobar", "Pelrodale", "Makyel", "de la Cruz", "Vanar", "Vana"]
    told = ["SemaSadiren", "Sema Sadiren", "Kador Hardware Ltd", "Kador Hdwe", "Kador Motors Pvt Ltd", "Kador & Sons", "Robert", "", "Dr", "Bob Grinobar jr"]
    for _ in range(250):
        w = list(f"{r.choice(given)} {r.choice(family)}")
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice(["", "a", "e", w[at] + "n", w[at] * 2])
        told.append("".join(w))
    screen = p5_names.Screen(nick)
    rows = screen.rows(told)
    i, j = (x.ravel() for x in np.indices((len(told), len(told))))
    may = screen(rows, rows, i, j)
    one = np.array([p5_names._level(told[a], told[b], nick) >= names.WEAK for a, b in zip(i, j)])
    assert one.sum() > 500 and not (one & ~may).any()
    told = [f"{a} {b}" for a in ("Anna", "Ibrahim", "Farida") for b in ("Grinobar", "Pelrodale", "Makyel", "Vanarhut")]
    rows = screen.rows(told)
    i, j = (x.ravel() for x in np.indices((12, 12)))
    assert (screen(rows, rows, i, j) == (i == j)).all()  # one word in common is not enough
