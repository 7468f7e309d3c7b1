"""SimHash classes against brute force: fingerprints bit by bit, links over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from lcarank.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, id string, variant string, label int, component int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _fingerprint(text, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(shingle, len(w))
    parts = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, radius):
    name = dict(enumerate(range(len(fps))))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and name[i] != name[j]:
                old, new = name[i], name[j]
                name = {k: new if v == old else v for k, v in name.items()}
    return name


def _texts():
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{rng.zipf(1.4) % 300}" for _ in range(n))
    texts = [prose(int(rng.integers(1, 60))) for _ in range(40)] + [prose(700), prose(20_000), "x" * 300 + " y " + "q" * 33 + " z"]
    base = prose(260)
    for i in range(30):  # near copies of one text
        w = base.split()
        for _ in range(i % 5):
            w[int(rng.integers(0, len(w)))] = f"edit{i}"
        texts.append(" ".join(w))
    return [*texts, base, base, base.upper(), None, None, "", " \t\n", "one", "one", "ONE two", "ÀÉ 日本語 naïve\x0bword\x0cword", "à b c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None if i == 45 else i, t, "x", "y", "z", 1, 2) for i, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA).repartition(3)


def test_fingerprints():
    texts = _texts()
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert got.tolist() == [_fingerprint(t) for t in texts]
    assert simhash.fingerprints([]).tolist() == []


def test_xxh64_of_every_length():
    data = np.random.default_rng(0).integers(0, 256, 400, dtype=np.uint8)
    starts = np.arange(0, 90)
    ends = starts + np.arange(0, 90) * 2
    got = simhash.xxh64_spans(data, starts, ends, 7)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 7) for s, e in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_equal_all_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        fps.add(x)
        for _ in range(12):  # chains of neighbours at every small distance
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    mask = (1 << 64) - 1
    pairs = [(r.a & mask, r.b & mask) for r in simhash.links(nodes, radius, bits=16).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in pairs)
    at = {x: i for i, x in enumerate(fps)}
    name = list(range(len(fps)))
    for a, b in pairs:
        old, new = name[at[a]], name[at[b]]
        name = [new if v == old else v for v in name]
    want = _components(fps, radius)
    groups = lambda names: {frozenset(i for i in range(len(fps)) if names[i] == names[j]) for j in range(len(fps))}
    assert groups(name) == groups(want)


def test_radius_out_of_range(spark):
    with pytest.raises(ValueError, match="radius"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 8)


def test_classes(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [_fingerprint(t) for _, t in rows]
    name = _components(fps, 3)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[name[i]] = min(least.get(name[i], d), d) if d is not None and least.get(name[i]) is not None else d if d is not None else least.get(name[i])
    want = sorted((str(d), f"{fps[i]:016x}", str(least[name[i]])) for i, (d, _) in enumerate(rows))
    out = simhash.simhash_classes(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out.collect()) == want
    assert len(set(want)) < len(want) and len({w[2] for w in want}) < len(want) - 20


def test_empty_table_and_query(spark, docs, tmp_path):
    assert simhash.simhash_classes(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_simhash_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, simhash.simhash_classes(docs).collect()))
