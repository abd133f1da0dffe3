"""Conversation tries, personal data and whitening against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import DATA
from oracle import connect, same
from pyspark.sql import functions as F

from storeops.llm import conversation_trie, pii, whitening

# Conversations

COLUMNS = "conv_id bigint, turn bigint, role string, text string, a bigint, depth string, shard string"


def told(turns):
    return hashlib.sha256(f"{len(turns[0] or '')}:{turns[0] or ''}{turns[1] or ''}".encode()).digest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, told((role, text))), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (saved + sum(sums[k][0] for k in children[node]), sum(sums[k][1] for k in children[node]) or 1)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), sums[node][1], sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rows = []
    for c in [*range(-120, -90), *range(0, 40), 99, 100, 103, 105, 199, 250, 251, 252, 1 << 40, (1 << 40) + 1]:
        rows += [(c, t, ("user", "assistant", None)[t % 3], f"{'same' if c % 3 else c % 7} {t}") for t in range(c % 5 + (c % 2) * 3 + 1)]
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(301, t, "user", f"long {t}" if t < 140 else "other") for t in range(150)] + [(302, 10_000 * t, "user", f"long {t}") for t in range(64)]
    rows += [(5, None, "user", "first"), (6, 0, None, None), (6, 0, "user", ""), (6, 0, "user", ""), (None, 1, "user", "nobody"), (400, 0, "u", "x" * 200_000)]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_trie_equals_brute_force(spark, tmp_path, partitions):
    rows = conversations()
    spark.createDataFrame([(*r, 1, "d", "s") for r in rows], COLUMNS).repartition(partitions).write.parquet(str(tmp_path / "conversations.parquet"))
    found = sorted((tuple(r) for r in conversation_trie.op11_conversation_trie(spark, str(tmp_path)).collect()), key=str)
    assert found == brute_trie(rows)


def test_trie_sql_equals_brute_force(tmp_path):
    rows = [r for r in conversations() if r[0] not in (5, 6)]  # SQL orders equal turns by their words
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(conversation_trie.ORACLE).fetchall(), key=str) == brute_trie(rows)


def test_trie_of_the_given_tables_equals_sql(spark):
    sf = f"{DATA}/sf0.01"
    same(conversation_trie.op11_conversation_trie(spark, sf), connect(sf), conversation_trie.ORACLE)


def test_trie_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert conversation_trie.op11_conversation_trie(spark, str(tmp_path)).collect() == []
    turns = conversation_trie.numbered(conversation_trie.marked_turns(spark.createDataFrame([(7, 1, "user", "a", 1, "", "")], COLUMNS)))
    ids = spark.createDataFrame([(7,), (3,), (3,)], "conv_id bigint")  # one has no turns
    found = {(r["depth"], r["conv_id"]): r for r in conversation_trie.prefix_trie(turns, ids).collect()}
    assert set(found) == {(0, 3), (1, 7)} and found[0, 3]["n_convs"] == 2 and found[1, 7]["parent_conv_id"] == 3
    assert found[0, 3]["ends_sha256"] == hashlib.sha256(b"3").hexdigest() and found[0, 3]["n_leaves"] == 1


def test_positions_cross_stretches_of_turn_numbers(spark):
    rows = [(1, t, "u", str(t), 0, "", "") for t in (None, -5, 3, 9_999, 10_000, 25_000, 25_001)]
    found = conversation_trie.numbered(conversation_trie.marked_turns(spark.createDataFrame(rows, COLUMNS).repartition(3))).collect()
    place = {bytes(r["digest"]): r["position"] for r in found}
    assert [place[told(("u", str(r[1])))] for r in rows] == [1, 2, 3, 4, 5, 6, 7]


# Personal data


def brute_base(text):
    """The patterns as the contract words them."""
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(n) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(n[::-1])) % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], pii.KINDS.index(s[0])))


TRICKY = [
    "", "no data", "a@b.c@d.e f@g", "x.y+z%@host-1.example.org.", "@a.b", "a@b", "a@@b.c", "1.2.3.4.5.6.7.8", "001.002.003.255", "1.2.3.256 256.1.2.3", "12 4111 1111 1111 1111", "4111-1111-1111-1111",
    "4111 1111  1111 1111", "+45 12 34 56 78", "+1 (555) 123-4567.", "++1 234 567 890", "+1 2", "+1-", "tel +12345678901234567", "é+44 20 7946 0958 ü", "🙂 a@b.c 🙂 1.1.1.1", "5105105105105100+1 555 123 4567", "1 2 3 4 5 6 7 8 9 0 1 2",
]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(4)
    texts = TRICKY + ["".join(rng.choice(list("01459.@+-() ab%é"), int(rng.integers(1, 60)))) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == brute_base(text), text


def test_base_spans_of_long_texts_take_time_in_proportion():
    import time

    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "+1" + "(" * 1_000_000, "@" * 1_000_000, "1 " * 500_000):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 5


def test_gradients_of_the_model():
    rng = np.random.default_rng(1)
    model = pii.Model.fresh(rng)
    w = model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, gold = rng.integers(0, 100, (7, 3)), np.zeros((7, 3), int)
    gold[2, 0], gold[3, 0], gold[4, 1] = 1, 2, 3
    step, first = pii.allowed()

    def loss():
        scores, kept = model.emissions(ids)
        return pii.crf(scores, gold, w["step"] + step, w["first"] + first), kept

    (_, d, d_step, d_first), kept = loss()
    for name, g in (model.gradients(d, kept) | {"step": d_step, "first": d_first}).items():
        flat, wanted = w[name].reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(wanted))[:4]:
            held = flat[k]
            flat[k] = held + 1e-3
            up = loss()[0][0]
            flat[k] = held - 1e-3
            down = loss()[0][0]
            flat[k] = held
            assert (up - down) / 2e-3 == pytest.approx(wanted[k], rel=1e-2, abs=1e-5), name


def test_best_path_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    model = pii.Model.fresh(rng)
    ids = rng.integers(0, 100, (4, 5))
    path, _ = model.decode(ids)
    scores, _ = model.emissions(ids)
    step, first = (model.weights[k] + x for k, x in zip(("step", "first"), pii.allowed(), strict=True))
    for b in range(5):
        best = max(product(range(pii.TAGS), repeat=4), key=lambda p: first[p[0]] + sum(scores[t, b, p[t]] for t in range(4)) + sum(step[p[t], p[t + 1]] for t in range(3)))
        assert tuple(path[:, b]) == best


def test_the_best_set_of_spans_equals_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(200):
        spans = {("ip", int(a), int(a + n)): float(x) for a, n, x in zip(rng.integers(0, 12, 6), rng.integers(1, 6, 6), rng.integers(-2, 9, 6), strict=True)}
        sets = [c for n in range(len(spans) + 1) for c in combinations(spans, n) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(c, 2))]
        assert sum(spans[s] for s in pii.best_set(spans)) == pytest.approx(max(sum(spans[s] for s in c) for c in sets))


EXTRA = "id string, spans string, base string, start string, kind string"


def test_pii_of_odd_tables_and_other_spellings(spark):
    hidden = "write to jane.doe (at) example (dot) org or to the shop"
    texts = [None, *TRICKY, hidden, "x " * 100_000 + "me@example.org " + "y " * 100_000, "me@example.org", "me@example.org"]
    rows = [(k if k % 5 else None, t, *"abcde") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {EXTRA}").repartition(3)
    model = pii.fit(docs)
    found = [tuple(r) for r in pii.find_pii(docs.withColumn("doc_id", F.col("text")), model).collect()]
    assert len(found) == len(texts)
    for text, spans in found:
        base = [tuple(s)[:3] for s in spans if s["base"]]
        assert base == brute_base(text or "")
        for s in spans:
            if not s["base"]:
                assert pii.fits(s["kind"], text[s["start"] : s["end"]]) and not any(a < s["end"] and s["start"] < b for _, a, b in base)
    more = next(s for t, s in found if t == hidden)
    assert [hidden[s["start"] : s["end"]] for s in more] == ["jane.doe (at) example (dot) org"]
    empty = docs.limit(0)
    assert pii.find_pii(empty, model).collect() == []


def test_op12_of_the_given_tables(spark):
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = pii.op12_pii(spark, sf).collect()
    assert len(found) == len(texts)
    clean, added = 0, 0
    for r in found:
        base = brute_base(texts[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        all_spans = [x for x in r["spans"].split(",") if x]
        assert set(filter(None, told.split(","))) <= set(all_spans)
        clean += not base
        added += not base and bool(all_spans)
    assert clean > 50 and added <= 0.02 * clean


def test_held_out_spellings_are_found():
    rows = pii.made_rows(["el camino es largo y the shop is open", "wenige worte über nichts"], 2_400, seed=5)
    ids, gold = (np.zeros((len(rows), pii.WINDOW), np.int64) for _ in range(2))
    for k, (text, own) in enumerate(rows):
        ids[k, : len(text)], gold[k, : len(own)] = pii.classes(pii.code_points(text)), own
    model = pii.fit_windows(ids[300:], gold[300:])
    path, _ = model.decode(ids[:300].T)
    assert (path.T == gold[:300]).all(axis=1).mean() > 0.85


# Whitening


def embeddings(spark, vectors, kind="float"):
    rows = [(k, v, 1, "c", 0.5) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, component bigint, id string, n double").repartition(3)


def whole(c):
    return np.floor(np.asarray(c, np.float64) * 1024).astype(np.int64) + 100_000


def expected(x, most=8):
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return n, ((n * x - s) ** 2).sum(axis=1), e[::-1][:most], u[:, ::-1][:, :most], e.sum(), z


@pytest.mark.parametrize(("n", "d"), [(300, 12), (40, 5), (6, 20)])
def test_whitening_equals_an_eigendecomposition(spark, n, d):
    rng = np.random.default_rng(n)
    c = rng.standard_normal((n, d)) * np.linspace(1, 3, d)
    odd = [None, [], [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1e30] * d, [1.0] * (d + 1)]
    df = embeddings(spark, c.tolist() + odd, "double")
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).toPandas()
    count, deviations, e, u, trace, z = expected(whole(c))
    k = min(8, d, n - 1)
    assert len(rows) == n * k and set(rows["n"]) == {count} and model.identity_error < 1e-9
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[range(n)].to_numpy()
    want = z @ u[:, :k] / np.sqrt(e[:k])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert np.allclose(rows.groupby("component")["explained"].first(), e[:k] / trace, rtol=1e-9)
    assert rows.groupby("vec_id")["deviation"].first().loc[range(n)].tolist() == deviations.tolist()


def test_equal_eigenvalues_are_all_found(spark):
    d = 6
    c = np.concatenate([np.eye(d), -np.eye(d)]) * 0.5
    model = whitening.fit(embeddings(spark, c.tolist()))
    assert len(model.values) == d and np.allclose(model.values, model.values[0]) and model.identity_error < 1e-9
    assert np.allclose(model.components @ model.components.T, np.eye(d))


def test_whitening_of_odd_tables(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        df = embeddings(spark, vectors)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    df = embeddings(spark, [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [4.0, 5.0]])
    rows = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(rows) == 4 and {r["component"] for r in rows} == {1} and rows[0]["explained"] == pytest.approx(1)


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 0]])
    model = whitening.Whitening(2, [int(v) for v in x.sum(axis=0)])
    assert model.deviations(x) == [None, None]
    assert model.differences(x).tolist() == [[1 << 40, 0], [-(1 << 40), 0]]
    assert whitening.Whitening(1 << 20, [5, 5]).deviations(np.array([[1 << 45, 0]])) == [None]


def test_op13_of_the_given_tables(spark):
    sf = f"{DATA}/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    count, deviations, e, u, trace, z = expected(whole(np.stack(table["embedding"])))
    rows = whitening.op13_whitening(spark, sf).toPandas()
    assert len(rows) == 8 * len(table) and rows["identity_error"].max() < 1e-9
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(z @ u / np.sqrt(e)), atol=1e-8)
    assert rows.groupby("vec_id")["deviation"].first().loc[table["vec_id"]].tolist() == deviations.tolist()
