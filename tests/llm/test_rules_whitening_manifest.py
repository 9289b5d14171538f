"""Quality rules, whitening and the manifest against brute force, planted rules and odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import merkle, quality_rules, queries, whitening
from emberline.llm.common import table

from .test_llm import ODD, docs_of

# 11 quality rules


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_and_base_rules_equal_brute_force(spark, data):
    out = queries.op11_quality_rules(spark, data).toPandas().set_index("doc_id")
    docs = table(spark, data, "documents").toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index)
    for i, text in docs["text"].items():
        want = counted(text)
        assert tuple(out.loc[i, BASE]) == want
        assert out.loc[i, "base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (out.loc[i, "base_failed"] and out.loc[i, "kept"])


def test_repeated_words_in_overlapping_and_neighbouring_windows(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "x a b c y a b c d a b c", "a b c d a b", "p q r s p q r t q r s", ""]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(9, None, "a")]
    out = quality_rules.statistics(docs_of(spark, rows)).toPandas().set_index("doc_id")
    assert out["n_repeat_words"].to_dict() == {i: counted(t)[4] for i, t, _ in rows}


def test_labels_are_learned_and_clean_documents_stay(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    m = queries.op11_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    judged = m[~m["base_failed"]]
    assert judged["rule"].notna().any()
    assert (judged["kept"] == (judged["quality"] == 1)).mean() > 0.97
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.99


def test_a_planted_conjunction_is_found(spark):
    rng = np.random.default_rng(5)
    a, b, c = (rng.integers(0, 1001, 4000) for _ in range(3))
    bad = (((a >= 600) & (b <= 300)) | (c >= 950)).astype(int)
    rows = spark.createDataFrame([(int(y), int(i % 3), int(p), int(q), int(r)) for i, (y, p, q, r) in enumerate(zip(bad, a, b, c))], "bad int, held int, a int, b int, c int")
    rules = quality_rules.learned(rows, ["a", "b", "c"])
    got = rows.withColumn("rule", quality_rules.verdict(rules)).withColumn("hit", F.col("rule").isNotNull().cast("int")).toPandas()
    assert (got["hit"] == got["bad"]).mean() > 0.99
    assert {c.feature for r in rules for c in r} == {"a", "b", "c"} and len(rules) <= 5
    assert all(len(r) <= quality_rules.CONDITIONS for r in rules) and "a >= 6" in " ".join(quality_rules.spelled(rules))


def test_the_best_condition_has_the_best_gain_of_all():
    rng = np.random.default_rng(8)
    counts = [(f, v, int(p), int(n)) for f in "uvw" for v, (p, n) in zip(range(0, 60, 3), rng.integers(0, 9, (20, 2)))]
    got, p, n = quality_rules.best_condition(counts)

    def gain(f, least, at):
        rows = [x for x in counts if x[0] == f]
        inside = [x for x in rows if (x[1] >= at if least else x[1] <= at)]
        q, m, all_q, all_m = sum(x[2] for x in inside), sum(x[3] for x in inside), sum(x[2] for x in rows), sum(x[3] for x in rows)
        return (q * (np.log2(q / (q + m)) - np.log2(all_q / (all_q + all_m))) if q else 0.0), q, m

    best = max(gain(f, least, at) for f in "uvw" for least in (True, False) for at in range(60))
    assert gain(got.feature, got.least, got.value) == pytest.approx(best) and (p, n) == best[1:]


def test_a_rule_is_pruned_to_what_holds_on_other_rows(spark):
    rows = spark.createDataFrame([(1, 1, 1)] * 9 + [(1, 1, 0)] * 5 + [(0, 0, 1)] * 9, "bad int, a int, b int")
    a, b = quality_rules.Condition("a", True, 1), quality_rules.Condition("b", True, 1)
    assert quality_rules.prune(rows, (a, b), 0.9) == (a,)
    assert quality_rules.prune(rows, (b,), 0.9) == ()


def test_quality_rules_odd_input(spark):
    odd = docs_of(spark, ODD)
    labels = spark.createDataFrame([(1, 0, 0), (5, None, 0), (6, 1, None), (6, 1, 0), (8, 7, 0), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(odd, labels).toPandas()
    assert len(out) == len(ODD) and out[out["doc_id"] == 1][BASE].iloc[0].tolist() == [0] * 5
    assert sorted(map(tuple, out[BASE].to_numpy().tolist())) == sorted(counted(t) for _, t, _ in ODD)
    assert quality_rules.quality_rules(docs_of(spark, []), labels.limit(0)).count() == 0
    assert quality_rules.quality_rules(odd, labels.limit(0)).filter("rule is not null").count() == 0


# 12 whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n long, component int")


def row(i, v):
    return (i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, 3)


def test_whitening_equals_exact_fractions(spark, data):
    out = queries.op12_whitening(spark, data).toPandas()
    emb = table(spark, data, "embeddings").toPandas()
    x = np.array([np.floor(np.float64(64) * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000 for v in emb["embedding"]])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov((fit - fit.mean(axis=0)).T, bias=True)
    value, vector = np.linalg.eigh(v)
    assert (out["n"] == n).all() and len(out) == 16 * len(emb)
    wide = out.pivot(index="vec_id", columns="component", values="whitened").loc[emb["vec_id"]].to_numpy()
    want = (x - s / n) @ vector[:, ::-1][:, :16] / np.sqrt(value[::-1][:16])
    for c in range(16):
        assert min(abs(wide[:, c] - want[:, c]).max(), abs(wide[:, c] + want[:, c]).max()) < 1e-6
    dev = out.drop_duplicates("vec_id").set_index("vec_id")["deviation"]
    for i, r in zip(emb["vec_id"], x.tolist()):
        assert dev[i] == sum((n * a - int(b)) ** 2 for a, b in zip(r, s))
    assert np.allclose(out.drop_duplicates("component").sort_values("component")["explained"], value[::-1][:16] / v.trace(), rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("big", [1, 1 << 28])
def test_covariance_from_variances_is_exact(spark, big):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (40, 5)) * big + rng.integers(0, 7, (40, 5))
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(3)
    *sums, n = whitening.summed(fit, 5, 6, whitening.column_sums)
    assert n == 40 and sums == x.sum(axis=0).tolist()
    centre = [(2 * s + n) // (2 * n) for s in sums]
    got = whitening.covariance(n, sums, centre, whitening.summed(fit, 5, 15, whitening.squares(np.array(centre))))
    for i in range(5):
        for j in range(5):
            want = sum((Fraction(int(a)) - Fraction(sums[i], n)) * (Fraction(int(b)) - Fraction(sums[j], n)) for a, b in zip(x[:, i], x[:, j])) / n
            assert got[i, j] == pytest.approx(float(want), rel=1e-14)


def test_whitening_odd_input(spark):
    rng = np.random.default_rng(4)
    good = [row(i, rng.normal(size=4)) for i in range(60)]
    rows = [*good, good[0], row(None, good[1][1]), row(100, None), row(101, []), row(102, [1, None, 2, 3]), row(103, [1, float("nan"), 2, 3]), row(104, [1, 2, float("inf"), 3]), row(105, [1, 2])]
    out = whitening.whitened(vectors(spark, rows)).toPandas()
    assert len(out) == 4 * 62 and set(out["n"]) == {60} and out["vec_id"].isna().sum() == 4
    assert out["identity_error"].max() < 1e-9 and out["explained"].drop_duplicates().sum() == pytest.approx(1)
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, rows[62:64])).count() == 0
    one = whitening.whitened(vectors(spark, good[:1] * 3)).toPandas()
    assert len(one) == 12 and one["whitened"].isna().all() and one["explained"].isna().all() and (one["deviation"] == 0).all()
    flat = whitening.whitened(vectors(spark, [row(i, [i, 2 * i, 1]) for i in range(9)])).toPandas()
    assert flat.groupby("component")["whitened"].apply(lambda c: c.isna().all()).tolist() == [False, True, True] and flat["identity_error"].max() < 1e-9


# 13 manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Top of a tree, and for each leaf its siblings left and right a level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, q in enumerate(at):
            run = q - q % 3
            ways[i].append(("".join(nodes[run:q]), "".join(nodes[q + 1 : run + 3])))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [q // 3 for q in at]
    return nodes[0], ways


def proofs(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for i, t, lang, source, chars in rows:
        leaf = sha(*map(spelled, (i, source, lang, chars, t)))
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by[source].append((i is not None, i or 0, leaf, sha(*map(spelled, (i, source, lang, chars, t.replace("\n", "") if even and t else t)))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    root, top = tree([low[s][0] for s in names])
    for s, above in zip(names, top):
        for (known, i, leaf, claimed), way in zip(sorted(by[s]), low[s][1]):
            fold = claimed
            for left, right in way + above:
                fold = sha(left, fold, right)
            yield i if known else None, leaf, low[s][0], root, sha(*(x for pair in way + above for x in pair)), fold, fold == root


def same(out, rows):
    got = sorted(map(str, (tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())))
    assert got == sorted(map(str, proofs(rows)))


def test_manifest_equals_brute_force_over_several_rounds(spark, monkeypatch):
    """Blocks of nine leaves, so that sources take one to four rounds; a hot source, odd texts, ids and sources."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, f"line {i}\nand another" * (i % 3), "en", "hot", i) for i in range(290)] + [(1000 + i, f"é{i}\n", None, f"s{i % 13}", None) for i in range(60)]
    rows += [(5000, "one", "de", "", 3), (5001, None, "de", None, None), (5002, "", None, None, 0), (None, "no\nid", "en", "hot", 5), (5003, "long word\n" * 30_000, "en", "s1", 1)]
    rows += [(7, "line 7\nand another", "en", "hot", 7), (5004, "twice\n", "en", "s2", 6), (5004, "twice\n", "en", "s2", 6)]
    docs = spark.createDataFrame([(*r, "g", 1, "h", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, h string, n int")
    out = merkle.manifest(docs).cache()
    same(out, rows)
    tampered = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] and "\n" in r[1]}
    assert {r["doc_id"] for r in out.filter("not verified").collect()} == tampered


def test_manifest_of_nothing_and_of_one(spark):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.manifest(spark.createDataFrame([], docs)).count() == 0
    same(merkle.manifest(spark.createDataFrame([(1, "a\nb", "en", "s", 3)], docs)), [(1, "a\nb", "en", "s", 3)])
