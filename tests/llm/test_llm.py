import random
import unicodedata
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from creditweave.llm import language, lookalike, mixing, names, quota, subjects, tokens


# ---- look-alike text

def test_equal_looking_names_become_equal(spark):
    same = ["Héléne  Rossi (3)", unicodedata.normalize("NFD", "Héléne Rossi (3)"), "Ｈéｌéｎｅ　Ｒｏｓｓｉ （３）", "H​éléne Rossi﻿ (3) ", "Неlеnе Rоѕѕi"]
    rows = [(i, s, "x") for i, s in enumerate([*same, "HÉLÉNE ROSSI (3)", "Helene Rossi", "Héléne Rossi (4)", None, "", " ", "a" * 70_000, "а" * 70_000, "ﬁne", "fine", "x²", "x2"])]
    df = spark.createDataFrame(rows, "id long, name string, form string")
    got = {(r[0], r[1]) for r in lookalike.look_alike_pairs(df, "id", "name").collect()}
    assert got == {(a, b) for a in range(4) for b in range(4) if a < b} | {(9, 10), (11, 12), (13, 14), (4, 6)}
    out = {r["id"]: r["out"] for r in lookalike.consistent(df, "name", "out").collect()}
    assert out[8] is None and out[9] == out[10] == "" and out[0] == "Héléne Rossi (3)"


def test_look_alikes_of_an_empty_table(spark):
    assert lookalike.look_alike_pairs(spark.createDataFrame([], "id long, name string"), "id", "name").count() == 0


def test_look_alikes_of_other_scripts_and_of_characters_the_corpus_never_had(spark):
    rows = [(1, "Sign Group"), (2, "ꓢiɡո Grουp"), (3, "Տi𝐠n Ꮐroսp"), (4, "Sign  Group"), (5, "Sign – Group"), (6, "Sign — Group")]
    df = spark.createDataFrame(rows, "id long, name string")
    assert {(r[0], r[1]) for r in lookalike.look_alike_pairs(df, "id", "name").collect()} == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    other = lookalike.Rewriter(lookalike.look_alike_classes({"a": 5}))
    assert other("Ⅻ ｆｏｎｔ 𝒻 ″x′′") == 'XII font f "x"'


def test_representative_is_the_most_frequent_member():
    classes = lookalike.look_alike_classes({"а": 9, "a": 2})
    assert classes["a"] == "а" and lookalike.look_alike_classes({"а": 1, "a": 2})["а"] == "a"


# ---- language

TEXTS = {
    "en": "She plays the guitar in a small band and writes songs for the choir.", "it": "Suona la chitarra in un piccolo gruppo e scrive canzoni per il coro.", "de": "Sie spielt Gitarre in einer kleinen Band und schreibt Lieder für den Chor.",
    "fr": "Elle joue de la guitare dans un petit groupe et écrit des chansons pour la chorale.", "es": "Toca la guitarra en un grupo pequeño y escribe canciones para el coro.", "pt": "Toca guitarra num pequeno grupo e escreve canções para o coro da cidade.",
}


def test_languages_of_segments(spark):
    rows = [(i, t, k, k) for i, (k, t) in enumerate(TEXTS.items())] + [(10, f"[b]{TEXTS['en']}[/b] {TEXTS['it']}\n{TEXTS['de'].upper()}", None, None)]
    rows += [(20, None, "en", None), (21, "", "en", None), (22, "[a123], [l5] 99 !", "en", None), (23, (TEXTS["fr"] + " ") * 2000, "xx", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string, segments string")
    proto = language.fit_prototypes(df, "text", "label")
    got = {r["id"]: [s["lang"] for s in r["segments"]] for r in language.languages(df, ["id"], "text", proto).collect()}
    assert [got[i] for i in range(6)] == [[k] for k in TEXTS]
    assert got[10] == ["en", "it", "de"] and got[20] == got[21] == got[22] == [] and len(got[23]) == 2000
    doc = {r["id"]: (r["lang"], r["confidence"]) for r in language.document_language(language.languages(df, ["id"], "text", proto)).collect()}
    assert doc[0][0] == "en" and 0 < doc[0][1] <= 1 and doc[20] == (None, None)
    assert language.languages(df.limit(0), ["id"], "text", proto).count() == 0


def test_wrong_labels_and_other_languages(spark):
    """A sixth of the labels is wrong, Italian outweighs all others, and texts in none of the languages are told apart."""
    rng = random.Random(3)
    other = ["Urodził się w małym mieście i przez wiele lat grał w orkiestrze.", "Он родился в маленьком городе и много лет играл в оркестре.", "彼は小さな町で生まれ、長年オーケストラで演奏した。"]
    rows = []
    for i in range(900):
        k = rng.choice([*TEXTS, "it", "it", "it", "it"])
        rows.append((i, TEXTS[k].replace("o", rng.choice("oóO"), 1) + f" {rng.choice(['Zorba', 'Quint', 'Vlado', 'Mira'])} {i}.", k if rng.random() < 5 / 6 else rng.choice(list(TEXTS)), k))
    df = spark.createDataFrame(rows + [(9000 + i, t, None, "und") for i, t in enumerate(other)], "id long, text string, label string, truth string")
    judged = language.document_language(language.languages(df, ["id", "truth"], "text", language.fit_prototypes(df, "text", "label"))).collect()
    assert sum(r["lang"] == r["truth"] for r in judged) >= 900
    assert all(r["lang"] == "und" and r["confidence"] == 0 for r in judged if r["truth"] == "und")


def test_cosines_are_those_of_the_bundled_vectors():
    space, texts = language.Space(), [*TEXTS.values(), "ab", "1 2 3", "la la la la"]
    proto = language.unit(np.random.default_rng(1).normal(size=(6, space.dimensions)))
    v = np.stack([space.of_text(t) for t in texts])
    got = language.Scorer(language.Prototypes(proto))(texts)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(got - v @ proto.T / np.where(n == 0, 1, n)).max() < 0.02 and not got[7].any()


@pytest.mark.parametrize(("label", "want"), [("it-IT", "it"), ("ITA", "it"), ("English", "en"), ("ger", "de"), ("und", None), ("", None), (None, None), ("pt-PT", "pt")])
def test_label_notations(spark, label, want):
    assert language.label_of(label) == want
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(language.label_column(df.l)).first()[0] == want


# ---- names

def _entities(spark, rows):
    df = spark.createDataFrame(rows, "artist_id long, name string, realname string, is_group boolean, debut_year double, gender string")
    return {r["artist_id"]: r["entity"] for r in names.linked_sets(df, "artist_id").collect()}


def test_variants_are_linked_and_families_are_not(spark):
    rows = [
        (1, "Giuseppe Quifongidorf", None, False, 1960.0, "M"), (2, "Quifongidorf, Giuseppe", None, False, 1960.0, "M"), (3, "G. Quifongidorf", None, False, 1961.0, None), (4, "Peppe Quifongidorf", None, False, None, "M"),
        (5, "Dr. GIUSEPPE QUIFNOGIDORF", None, False, 1960.0, "M"), (6, "Dj Zork", "Giuseppe Quifongidorf", False, 1960.0, None), (7, "Maria Quifongidorf", None, False, 1990.0, "F"),
        (11, "Anna Vristein (3)", None, False, 1970.0, "F"), (12, "Anna Vristein (4)", None, False, 1990.0, "F"), (13, "Anna  Vristein (3)", None, False, 1971.0, "F"),
        (21, "The Quifongidorf Band", None, True, None, None), (22, "Quifongidorf Bnd.", None, True, None, None), (23, "Coro Quifongidorf", None, True, None, None),
        (31, None, None, None, None, None), (32, "", " ", False, None, None), (33, "x" * 30_000, None, False, None, None),
    ]
    got = _entities(spark, rows)
    assert {got[i] for i in range(1, 7)} == {1} and got[7] == 7
    assert got[11] == got[13] != got[12] and got[21] == got[22] != got[23] and got[21] not in (1, 7)
    assert got[31] == 31 and got[32] == 32 and got[33] == 33


def test_near_cores_are_complete(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(250)}
    got = {(r[1], r[2]) for r in names.near_cores(spark.createDataFrame([(False, w) for w in words], "is_group boolean, core string")).collect()}
    want = {(a, b) for a in words for b in words if a < b and min(len(a), len(b)) >= names.SHORTEST and _osa(a, b) <= 1}
    assert got == want


def test_near_cores_of_two_edits_are_complete(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(8, 13))) for _ in range(160)}
    got = {(r[1], r[2]) for r in names.near_cores(spark.createDataFrame([(False, w) for w in words], "is_group boolean, core string"), 2).collect()}
    want = {(a, b) for a in words for b in words if a < b and _osa(a, b) <= (2 if min(len(a), len(b)) >= 2 * names.SHORTEST else 1)}
    assert got == want and any(_osa(a, b) == 2 for a, b in got)


def test_links_of_a_block_become_stars():
    got = sorted(names._stars(iter([(5, 7), (7, 3), (9, 8), (4, 4)])))
    assert got == [(5, 3), (7, 3), (9, 8)]


def _osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        for most in (1, 2, 3):
            assert names.banded_distance(a, b, most) == min(_osa(a, b), most + 1)


# ---- quotas

def test_allocation_keeps_bounds_and_total():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = int(rng.integers(1, 9))
        w, caps = rng.random(k), rng.integers(0, 60, k)
        floors = rng.integers(0, 5, k)
        n = int(rng.integers(0, 120))
        q = quota.allocate(w, floors, caps, n)
        low = np.minimum(floors, caps)
        assert (q <= caps).all() and (q >= low).all()
        assert q.sum() == max(min(n, caps.sum()), low.sum())
    assert quota.allocate(np.array([0.5, 0.3, 0.2]), np.zeros(3, int), np.full(3, 99), 7).tolist() == [4, 2, 1]


def test_sample_follows_targets_and_reports_shortfalls(spark):
    rows = [(i, "ab"[i % 2] if i % 50 else None, "r" if i < 8 else "xyz"[i % 3], "t") for i in range(3000)] + [(5000, None, None, None)]
    df = spark.createDataFrame(rows, "id long, f string, g string, category string")
    t = spark.createDataFrame([("f", "a", 0.75, 5), ("f", "b", 0.25, 5), ("g", "x", 0.5, 5), ("g", "y", 0.3, 5), ("g", "z", 0.1, 5), ("g", "r", 0.08, 5), ("g", "none", 0.02, 5)], "field_name string, category string, target_share double, min_rows long")
    sample, report = quota.quota_sample(df, "id", ["f", "g"], t)
    rows = {(r["field_name"], r["category"]): r for r in report.collect()}
    assert {k for k, r in rows.items() if r["shortfall"]} == {("g", "r"), ("g", "none")}
    assert abs(rows["f", "a"]["n_drawn"] - 225) <= 10 and abs(rows["g", "x"]["n_drawn"] - 160) <= 20 and rows["g", "r"]["n_drawn"] >= 5
    ids = [r["id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) and abs(len(ids) - 300) <= 10
    assert sorted(r["id"] for r in quota.quota_sample(df.repartition(7), "id", ["f", "g"], t)[0].collect()) == sorted(ids)
    empty, rep = quota.quota_sample(df.limit(0), "id", ["f", "g"], t)
    assert empty.count() == 0 and rep.where("shortfall").count() == 7


def test_fields_that_exclude_each_other_are_reported(spark):
    """All rows of kind n are in bin low, so a quarter of low and a tenth of n can't both be met."""
    rows = [(i, "low" if i % 3 == 0 else "high", "n" if i % 3 == 0 else "mn"[0] if i % 2 else "o") for i in range(3000)]
    t = spark.createDataFrame([("f", "low", 0.25, 1), ("f", "high", 0.75, 1), ("g", "n", 0.1, 1), ("g", "m", 0.5, 1), ("g", "o", 0.4, 1)], "field_name string, category string, target_share double, min_rows long")
    _, report = quota.quota_sample(spark.createDataFrame(rows, "id long, f string, g string"), "id", ["f", "g"], t)
    got = {(r["field_name"], r["category"]): r for r in report.collect()}
    short = {k: r["reason"] for k, r in got.items() if r["shortfall"]}
    assert short and set(short.values()) == {"fields exclude each other"} and all(got[k]["missing"] == got[k]["quota"] - got[k]["n_drawn"] > 0 for k in short)
    assert sum(r["n_drawn"] for k, r in got.items() if k[0] == "f") == sum(r["n_drawn"] for k, r in got.items() if k[0] == "g") == 300


def test_quotas_that_can_all_be_met_are_met(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aab"), rng.choice("xxyz"), rng.choice("pq")) for i in range(4000)]
    t = [("f", "a", 0.37, 1), ("f", "b", 0.63, 1), ("g", "x", 0.21, 1), ("g", "y", 0.33, 1), ("g", "z", 0.46, 1), ("h", "p", 0.509, 1), ("h", "q", 0.491, 1)]
    _, report = quota.quota_sample(spark.createDataFrame(rows, "id long, f string, g string, h string"), "id", ["f", "g", "h"], spark.createDataFrame(t, "field_name string, category string, target_share double, min_rows long"))
    assert all(r["n_drawn"] == r["quota"] and not r["shortfall"] and r["reason"] is None for r in report.collect())


# ---- tokens

def test_tree_concatenation_is_exact():
    enc, rng = tokens.encoder(), random.Random(3)
    with ThreadPoolExecutor(2) as pool:
        for _ in range(1500):
            alphabet = rng.choice(["ab", "abcdefghijklmnop", "a b\n", "é日本a1", "  \n\t\x1cx", "ab's12 ,.", "the of ing er"])
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
            assert tokens.encode_long(enc, text, pool, rng.choice([1, 2, 3, 7, 20, 50])) == enc.encode_ordinary(text)


def test_halves_joined_are_the_encoding_of_the_whole():
    enc, rng = tokens.encoder(), random.Random(9)
    for _ in range(1500):
        alphabet = rng.choice(["ab", "a b\n", "é日本a1。，", "  \n\t\x1cx", "ab's12 ,.", "a.b, c!'s 12", "日本語。テスト,abc 1"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        assert tokens.encode_tree(enc, text, rng.choice([1, 2, 5, 20, 60])) == enc.encode_ordinary(text)


def test_long_documents_are_joined_and_equal(spark):
    df = spark.createDataFrame([(1, "The record was made. " * 200), (2, "short"), (3, None), (4, "日本語。" * 900)], "doc_id long, text string")
    assert tuple(tokens.joined_exactly(df, "text").first()) == (4, 2, 4)
    assert tuple(tokens.joined_exactly(df.limit(0), "text").first()) == (0, 0, 0)


def test_ids_of_documents(spark):
    texts = ["Hello <|endoftext|> world", None, "", " ", "x" * 450_000 + " end", "Hello <|endoftext|> world"]
    df = spark.createDataFrame([(i % 5, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    enc = tokens.encoder()
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.token_ids(df, ["doc_id"], "text").collect())
    assert got == sorted((i % 5, enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert all(max(x, default=0) < 50256 for _, x in got)
    assert enc.decode(got[0][1]) == "Hello <|endoftext|> world"
    n = sorted((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(df, ["doc_id"], "text").collect())
    assert n == sorted((i, len(x)) for i, x in got)


# ---- mixing

def test_pivotal_keeps_the_sum_and_the_means():
    rng = np.random.default_rng(6)
    p = rng.random(40)
    total = np.zeros(40)
    for _ in range(4000):
        q = mixing.pivotal(p, rng)
        assert abs(q.sum() - p.sum()) < 1e-9 and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        total += q
    assert np.abs(total / 4000 - p).max() < 0.05


def test_shares_and_caps(spark):
    rows = [(i, "big", 10 + i % 5) for i in range(4000)] + [(10_000 + i, "mid", 20) for i in range(700)] + [(20_000 + i, "tiny", 5) for i in range(20)] + [(30_000, None, 50), (30_001, "other", 50), (30_002, "mid", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.4, 2), ("tiny", 0.08, 3), ("gone", 0.02, 9)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs, t, block=150)
    r = {x["source"]: x for x in report.collect()}
    assert {k for k, x in r.items() if x["short"]} == {"tiny", "gone"} and r["tiny"]["taken"] == 300 and r["gone"]["taken"] == 0
    for k in ("big", "mid"):
        assert abs(r[k]["reached_share"] - r[k]["target_share"]) < 0.005
    assert abs(sum(x["share_of_mix"] for x in r.values()) - 1) < 1e-9 and r["big"]["share_of_mix"] > r["big"]["reached_share"]
    assert {x["source"] for x in used.select("source").distinct().collect()} == {"big", "mid", "tiny"}
    most = {"big": 2, "mid": 2, "tiny": 3}
    assert all(x["copies"] <= most[x["source"]] for x in used.collect())
    empty, rep = mixing.mix(docs.limit(0), t)
    assert empty.count() == 0 and rep.count() == 4


# ---- subjects

def test_subjects_on_held_out_documents(spark):
    rng = random.Random(8)
    words = {"law": ["court", "judge", "lawsuit", "statute", "clause"], "sport": ["match", "goal", "referee", "stadium", "league"], "science": ["theory", "experiment", "variance", "sample", "model"]}
    filler = ["The band played on until late.", "Side two opens slowly.", "It was issued again in spring.", "A fine record for a quiet evening."]

    def doc(kinds):
        s = [f"The {rng.choice(words[k])} changed how the band saw the {rng.choice(words[k])}." for k in kinds for _ in range(5)] + rng.sample(filler, 3)
        rng.shuffle(s)
        return " ".join(s)

    truth = [rng.sample(list(words), rng.choice([1, 1, 2])) for _ in range(400)]
    docs = spark.createDataFrame([(i, doc(k)) for i, k in enumerate(truth)] + [(900, None), (901, ""), (902, "  "), (903, doc(["law"]) * 400)], "doc_id long, text string")
    labels = [(i, k if rng.random() > 0.05 else rng.choice(list(words))) for i in range(250) for k in truth[i]] + [(3, None), (5, "nothing"), (77777, "law")]
    model = subjects.fit_subjects(docs, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(k,) for k in words], "subject string"))
    got = {}
    for r in subjects.subjects_of(docs, ["doc_id"], "text", model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == set(truth[i]) for i in range(250, 400))
    assert right >= 140 and not {900, 901, 902} & set(got) and "law" in got[903]
