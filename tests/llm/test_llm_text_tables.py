"""Operators over documents against brute force, with nulls, empty and long texts, repeats and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lcarank.llm import decontaminate, jaccard_join, language_id, pii, quality_classifier, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, id string, n_words string, row int"


def _prose(rng, n, words=400):
    return " ".join(f"w{rng.zipf(1.3) % words}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def _rows():
    rng = np.random.default_rng(7)
    base, passage = _prose(rng, 120), _prose(rng, 45)
    rows = [(i, _prose(rng, int(rng.integers(1, 90)))) for i in range(40)]
    rows += [(100 + i, base) for i in range(6)]  # copies
    for i in range(12):  # near copies
        w = base.split()
        for _ in range(i % 4):
            w[int(rng.integers(0, len(w)))] = f"edit{i}"
        rows.append((120 + i, " ".join(w)))
    rows += [(140 + i, f"{_prose(rng, 30)}\n{passage}\n{_prose(rng, 30)}") for i in range(8)]  # a shared passage
    rows += [(160, None), (161, ""), (162, " \t\n"), (163, "one"), (164, "one"), (165, "ONE two"), (166, "one TWO"),
             (167, "same " * 70), (168, "ÀÉ 日本語 naïve\x0bword\x0cword"), (169, _prose(rng, 9000)), (170, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3),
             (171, _prose(rng, 6) + "\nline one\nline one\n\n"), (None, _prose(rng, 25)), (163, "one"), (100, base)]
    for n in (8, 9, 10, 11, 18, 19, 20, 21, 22):  # sizes around the boundary, one word apart
        w = [f"s{n}x{k}" for k in range(n + 2)]
        rows += [(200 + 4 * n, " ".join(w)), (201 + 4 * n, " ".join(w[:-1])), (202 + 4 * n, " ".join(["other", *w[1:]])), (203 + 4 * n, " ".join([*w, "more"]))]
    return [(i, t, "xx" if k % 3 else None, f"id{k}", "clash", k) for k, (i, t) in enumerate(rows)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _classes(shingle, percent):
    sets = []
    for _, t, *_ in ROWS:
        w = WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        k = min(shingle, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a in range(len(sets)):
        if ROWS[a][0] is not None:
            least[root(a)].append(ROWS[a][0])
    return Counter((ROWS[a][0], len(s), min(least[root(a)]) if least[root(a)] else None) for a, s in enumerate(sets))


@pytest.mark.parametrize(("shingle", "percent", "light"), [(3, 90, None), (3, 90, 0), (5, 80, 12)])
def test_similarity_classes_equal_all_pairs(docs, shingle, percent, light):
    got = jaccard_join.similarity_classes(docs, rule=jaccard_join.Rule(shingle, percent), light=light).collect()
    assert Counter(map(tuple, got)) == _classes(shingle, percent)


def test_join_bounds_are_lossless():
    for percent in (80, 90):
        rule = jaccard_join.Rule(3, percent)
        for s in range(1, 30):
            for t in range(1, 30):
                o = rule.shared_needed(s, t)
                assert 100 * o >= percent * (s + t - o) and not 100 * (o - 1) >= percent * (s + t - o + 1)
                if rule.fits(s, t) and o <= min(s, t):
                    assert o in rule.subset_sizes(s) and o in rule.subset_sizes(t)
                    assert s - o < rule.prefix_size(s) and t - o < rule.prefix_size(t)
    assert jaccard_join.Rule().boundary({5: 10, 30: 10}, 0.0) < jaccard_join.LIGHT_MAX


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 100)], "a long, b long")
    found = {r["node"]: r["label"] for r in jaccard_join.components(links).collect()}
    assert len({found[i] for i in range(61)}) == 1 and found[100] == found[101] == found[102] != found[0]


def test_one_of_each_keeps_whole_rows(docs):
    """Of every class one row stays: of its smallest id; texts without words stay."""
    kept = jaccard_join.one_of_each(docs, jaccard_join.Rule())
    assert kept.columns == docs.columns
    classes = defaultdict(list)
    for (i, _, own), n in _classes(3, 90).items():
        classes[own].append((i, n))
    empty = {i for i, t, *_ in ROWS if not WORD.findall(t or "")}
    want = Counter(own for own in classes if own not in empty) + Counter(i for i, t, *_ in ROWS if i in empty)
    got = kept.collect()
    assert Counter(r["doc_id"] for r in got) == want
    assert {tuple(r) for r in got} <= set(ROWS) and len({tuple(r) for r in got}) == len(got)


def test_one_of_each_by_row(spark):
    """Rows of one id and different texts are rows of their own; rows alike stay once; rows without an id too."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "y"), (3, c, "y"), (None, b, "x"), (None, "all alone here now", "x"), (None, "all alone here now", "x"),
            (4, None, "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(df, jaccard_join.Rule()).collect())
    assert got == Counter([(1, a), (2, b), (3, c), (None, "all alone here now"), (4, None), (4, None), (5, "")])


def test_long_sets_are_compared_by_counts(spark):
    """Sets beyond the count maps' limit: links stay, and pairs that share one passage only are ruled out."""
    rng = np.random.default_rng(2)
    base = [f"v{x}" for x in rng.integers(0, 10**6, 6000)]
    near = [*base[:5900], *(f"u{x}" for x in range(100))]
    part = [*base[:900], *(f"t{x}" for x in rng.integers(0, 10**6, 5100))]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(part)), (4, " ".join(base[:1500]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def _repeats_removed():
    seen, out = defaultdict(list), []
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is None, ROWS[k][0] or 0))
    words = [WORD.findall(t or "") for _, t, *_ in ROWS]
    for k in order:
        if ROWS[k][0] is not None:
            for i in range(len(words[k]) - 19):
                seen[tuple(words[k][i:i + 20])].append(ROWS[k][0])
    for k, w in enumerate(words):
        gone, own = [False] * len(w), set()
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            if key in own or ROWS[k][0] is not None and min(seen[key]) < ROWS[k][0]:
                gone[i:i + 20] = [True] * 20
            own.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((ROWS[k][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits", [20, 8])
def test_substring_dedup_equals_brute_force(docs, bits):
    # 8 bits: the sketch is full and must let everything pass
    got = substring_dedup.remove_repeats(docs, bits=bits, hashed=True).collect()
    assert Counter(map(tuple, got)) == _repeats_removed()


def test_substring_dedup_keeps_words(docs):
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(docs).where("doc_id in (160, 163, 168, 0)").collect()}
    assert got[160] == "" and got[163] == "one" and got[168] == "ÀÉ 日本語 naïve word word" and got[0] == " ".join(ROWS[0][1].split())


LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _bench():
    w = ROWS[5][1].split()
    return [(1, ROWS[140 - 100 + 18][1]), (2, " ".join(ROWS[41][1].split()[20:33]).upper()), (10, "one, TWO"), (3, None), (4, "--"), (2, " ".join(w[:12])), (7, "naïve")]


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination_equals_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(_bench(), "item_id long, text string")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: LETTERS.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for item, text in _bench():
        w = words(text)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(str(item))
    want, clean = [], []
    for i, t, *_ in ROWS:
        w = words(t)
        hit, items = [0] * len(w), set()
        for key, owners in windows.items():
            for p in range(len(w) - len(key) + 1):
                if tuple(w[p:p + len(key)]) == key:
                    hit[p:p + len(key)] = [1] * len(key)
                    items |= owners
        want.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0))
        if not sum(hit):
            clean.append((i, t))
    assert Counter(map(tuple, decontaminate.digest(docs, bench).collect())) == Counter(want)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(clean)
    assert sum(x[-1] for x in want) > 5


def test_longest_matches_are_maximal(spark):
    bench = spark.createDataFrame([(9, "z z " + " ".join(f"b{i}" for i in range(15)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(f"B{i}" for i in range(2, 15)) + " y"), (2, "nothing here")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()] == [(1, "9", 4, 1, 13)]


def _quality_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = [0] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            hit[i:i + 5] = [1] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit), len(w) < 10 or 100 * sum(hit) > 20 * len(w)


def _model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_quality_rules_base_counts(docs):
    got = quality_rules.digest(docs, *_model()).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *_quality_base(t)) for i, t, *_ in ROWS)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality_rules.keep_good(docs, *_model())
    assert kept.columns == docs.columns
    assert Counter(r["id"] for r in kept.collect()) == Counter(r2 for r2 in (x[3] for x in ROWS) if r2 in _kept_ids(docs))


def _kept_ids(docs):
    figures = quality_rules.measure(docs, *_model(), keep=True)
    return {r["id"] for r in quality_rules.judged(figures).where("kept").select("row.id").collect()}


def test_quality_bands_reject_what_lies_far(spark):
    rng = np.random.default_rng(1)
    rows = [(i, _prose(rng, 200), "en") for i in range(80)] + [(900, " ".join(f"#$%{c}@!~`^" for c in "qwertyuiopasdfghjklzxcvbnm" * 8), "en"), (901, _prose(rng, 200), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *_model()).collect()}
    assert not got[900] and sum(got[i] for i in range(80)) >= 78


def test_quality_bands_of_thin_cells_follow_length(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(["ka", "mo", "ti", "su", "re", "na", "lo"], 3)) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, make(int(rng.integers(280, 320))), "en") for i in range(80)]
    rows += [(100 + i, make(10 + i % 11), "en") for i in range(12)] + [(200 + i, make(1200), "en") for i in range(4)]
    rows += [(300, "to be or " * 5 + "not", "en"), (301, " ".join(f"\u16a0{c}\u16b1" for c in "abcdefghijklmn"), "en")]
    rows += [(400 + i, make(10 + 3 * i), "es") for i in range(36)] + [(500 + i, make(12), "xx") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *_model()).collect()}
    assert all(got[100 + i] for i in range(12)) and all(got[200 + i] for i in range(4))
    assert not got[300] and not got[301]
    assert sum(got[400 + i] for i in range(36)) >= 34 and all(got[500 + i] for i in range(5))


def test_rare_languages_are_judged_by_their_script(spark):
    """Junk of a language of few texts goes, its clean texts stay, however many there are; a script that no language
    of LEAST texts writes has a band of its own, or none."""
    rng = np.random.default_rng(21)
    latin = ["".join(rng.choice(["ka", "mo", "ti", "su", "re", "na", "lo"], 3)) for _ in range(300)]
    other = ["".join(rng.choice(["vel", "dor", "mis", "pan", "ces"], 2)) for _ in range(300)]
    greek = ["".join(rng.choice(["και", "μον", "τις", "ερα"], 2)) for _ in range(300)]
    make = lambda words, n: " ".join(rng.choice(words, n))
    junk = lambda: " ".join(f"{c}@!~`^{c}{c}" for c in rng.choice(list("qwertyuiop"), 150))
    rows = [(i, make(latin, int(rng.integers(80, 160))), "en") for i in range(90)] + [(100 + i, make(other, int(rng.integers(80, 160))), "de") for i in range(60)]
    rows += [(200, make(latin, 120), "xx"), (201, junk(), "xx"), (202, make(other, 100), None), (203, junk(), None), (204, make(latin, 12), "yy"), (205, make(latin, 900), "yy")]
    rows += [(300 + i, junk(), "zz") for i in range(29)] + [(400 + i, make(greek, 100), "el") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *_model()).collect()}
    assert [got[i] for i in (200, 202, 204, 205)] == [True] * 4 and not any(got[i] for i in (201, 203)) and not any(got[300 + i] for i in range(29))
    assert all(got[400 + i] for i in range(5)) and sum(got[i] for i in range(90)) >= 87 and sum(got[100 + i] for i in range(60)) >= 58


def test_quality_bands_do_not_depend_on_partitions(spark):
    rows = [(i, t, lang) for i, t, lang, *_ in ROWS if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (sorted(str(tuple(r)) for r in quality_rules.digest(df.repartition(n), *_model()).collect()) for n in (1, 7))
    assert one == many


def test_quality_bands_count_copies_once(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(["ka", "mo", "ti", "su", "re", "na", "lo"], 3)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[:4 + i // 4], 200)), "en") for i in range(120)] + [(900, "to be or not " * 50, "en")]
    kept = []
    for copies in (0, 3000):
        df = spark.createDataFrame(rows + [(1000 + i, rows[119][1], "en") for i in range(copies)], "doc_id long, text string, lang string")
        got = {r["doc_id"]: r["kept"] for r in quality_rules.digest(df.repartition(4), *_model()).collect()}
        assert len(got) == len(rows) + copies and all(got[1000 + i] == got[119] for i in range(copies))
        kept.append({i: got[i] for i, *_ in rows})
    assert kept[0] == kept[1] and sum(kept[0].values()) >= 60


def test_language_model_learns_and_splits(spark, docs):
    rng = np.random.default_rng(3)
    make = lambda stems, n: " ".join("".join(rng.choice(stems, 2)) for _ in range(n))
    langs = {"aa": ["kal", "mor", "tin", "sul"], "bb": ["ère", "ois", "eau", "pré"], "ru": ["дом", "лес", "река", "мир"]}
    rows = [(k, make(stems, 60), lang) for k, (lang, stems) in enumerate((x for x in langs.items() for _ in range(30)))]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(learned.where(~language_id.held_out()))
    mixed = make(langs["aa"], 40) + " " + make(langs["bb"], 25)
    cases = spark.createDataFrame([(1, mixed), (2, make(langs["ru"], 3)), (3, None), (4, ""), (5, "123 !!"), (6, make(langs["bb"], 50)), (6, make(langs["bb"], 50))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.label_spans(cases, model).collect()}
    assert got[1]["lang"] == "aa" and [s["lang"] for s in got[1]["spans"]] == ["aa", "bb"] and abs(got[1]["spans"][0]["end"] - 40) <= 1
    assert 0.5 < got[1]["score"] < 1 and got[2]["lang"] == "ru" and got[6]["lang"] == "bb"
    assert [(got[i]["lang"], got[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3
    whole = language_id.digest(learned).where("held_out").collect()
    assert all(langs[r["lang_pred"]] == list(langs.values())[r["doc_id"] // 30] for r in whole)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in whole)


def test_viterbi_shortcut_equals_full_search(spark):
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.normal(0, rng.uniform(1, 6), (int(rng.integers(1, 12)), 3))
        best, value = None, None
        for code in np.ndindex(*[3] * min(len(scores), 7)):
            s = scores[:len(code)]
            v = sum(s[i, c] for i, c in enumerate(code)) - language_id.SWITCH * sum(a != b for a, b in zip(code, code[1:], strict=False))
            if value is None or v > value:
                best, value = code, v
        assert tuple(language_id.best_path(scores[:len(best)])) == best


def test_paths_equal_full_search(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [np.array([[0, -4, -1.0]] * 5 + [[-4, 0, -1.0]] * 5)]  # two languages, neither the best single one
    texts += [rng.normal(0, rng.uniform(0.5, 4), (int(rng.integers(1, 15)), 3)) for _ in range(300)]
    counts = np.array([len(x) for x in texts])
    w = SimpleNamespace(counts=counts, base=np.concatenate([[0], np.cumsum(counts)]), texts=lambda: np.repeat(np.arange(len(counts)), counts))
    monkeypatch.setattr(language_id, "word_scores", lambda w, model: np.concatenate(texts))
    got = language_id.paths(w, {})
    assert got[:10].tolist() == [0] * 5 + [1] * 5

    def value(scores, path):
        return scores[np.arange(len(path)), path].sum() - language_id.SWITCH * (path[1:] != path[:-1]).sum()

    for d, scores in enumerate(texts):
        assert np.isclose(value(scores, got[w.base[d]:w.base[d + 1]]), value(scores, language_id.best_path(scores)))


def test_rises_and_paths_of_many_texts():
    rng = np.random.default_rng(8)
    for _ in range(100):
        counts = rng.integers(1, 9, rng.integers(1, 8))
        starts, gains = np.cumsum(counts) - counts, rng.normal(0, rng.uniform(0.1, 1e4), counts.sum())
        want = [max(gains[s + i:s + j + 1].sum() for i in range(c) for j in range(i, c)) for s, c in zip(starts, counts, strict=True)]
        assert np.allclose(language_id._rises(gains, starts), want)
        scores, path = rng.normal(0, 6, (counts.sum(), 3)), np.zeros(counts.sum(), np.int64)
        language_id.best_paths(scores, starts, counts, path)
        assert path.tolist() == [x for s, c in zip(starts, counts, strict=True) for x in language_id.best_path(scores[s:s + c]).tolist()]


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None, "some words here", "en"), (1, "some words here", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["held_out"] for r in language_id.digest(df).collect()}[None] is False


def test_classifier_tells_marked_and_repeated_texts(spark, docs):
    rng = np.random.default_rng(2)
    good = [(i, _prose(rng, 120).replace("w", "word").capitalize()) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}***" for w in _prose(rng, 100).split())) for i in range(8)] + [(120 + i, "Buy now " * 60) for i in range(6)]
    df = spark.createDataFrame([*good, *bad, (300, None), (301, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_classifier.digest(df).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert not got[300]["kept"] and got[300]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality_classifier.digest(docs).count() == len(ROWS)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.8
    n = len(quality_classifier.LABELLERS)
    right = np.linspace(0.7, 0.95, n)
    patterns = Counter(tuple(np.where(rng.random(n) < right, 1, -1) * (1 if t else -1)) for t in truth)
    model = quality_classifier.fit_labellers({tuple(map(int, k)): v for k, v in patterns.items()})
    assert abs(model["share"] - 0.8) < 0.05 and model["good"][-1, 2] > model["good"][0, 2] > 0.6


def test_ibans_end_at_their_countrys_length():
    be, es, de = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"
    found = lambda text: [text[s:e] for kind, s, e, _ in pii.find_spans(text) if kind == "iban"]
    for iban in (be, es, de, be.replace(" ", "")):
        for after in ("", " BIC", " OR", " BANK NAME", " ABCDEFGH", ", then"):
            assert found(f"pay {iban}{after}") == [iban]
    assert found(f"{be} {es} {be}") == [be, es, be]
    assert found("BE68 5390 0754 7035 BIC") == found("BE68539007547034BIC") == found("BE68 5390 0754") == []


def test_operators_take_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (jaccard_join.similarity_classes(empty), substring_dedup.digest(empty), decontaminate.digest(empty, bench),
               quality_rules.digest(empty, *_model()), language_id.digest(empty), quality_classifier.digest(empty), pii.digest(empty)):
        assert df.count() == 0
    assert decontaminate.digest(spark.createDataFrame(ROWS[:5], SCHEMA), bench).where(F.col("contaminated")).count() == 0
