import io
import wave

import numpy as np
import pytest

from quillspark.llm import chroma as ch

SCHEMA = "doc_id long, text string, digest string, n_prints int"


def plain_integers(image):
    """The filters by adding up rectangles directly."""
    out = []
    for t in range(len(image) - ch.LONGEST + 1):
        bits = 0
        for kind, c, h, w in ch.FILTERS:
            box = image[t : t + w, c : c + h]
            whole = box.sum()
            if kind == 0:
                part, rest = whole, (image[t : t + w].sum() - whole) * h / max(1, 12 - h)
            else:
                half_t, half_c, a, b = w // 2, h // 2, w // 3, max(1, h // 3)
                part = [0, box[half_t:].sum(), box[:, half_c:].sum(), box[:half_t, :half_c].sum() + box[half_t:, half_c:].sum(), box[a : 2 * a].sum(), box[:, b : 2 * b].sum()][kind]
                rest, part = max(whole - part, 0), part * (2 if kind > 3 else 1)
            part, rest, ratio = 0.1 * ch.UNIT + part, 0.1 * ch.UNIT + rest, np.exp(ch.QUARTILE[kind])
            level = int(part * ratio > rest) + int(part > rest) + int(part > rest * ratio)
            bits = bits << 2 | (level ^ level >> 1)
        out.append(bits)
    return out


def test_integral_image_equals_direct_sums():
    image = np.random.default_rng(1).integers(0, ch.UNIT, (40, 12))
    assert ch.integers(image).tolist() == plain_integers(image)


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


def edited(rng, text, n):
    parts = text.split()
    for i in rng.choice(len(parts), min(n, len(parts)), replace=False):
        parts[i] = f"x{rng.integers(1 << 20)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    out = [(i, words(rng, int(rng.integers(1, 250)))) for i in range(150)]
    base = words(rng, 200)
    out += [(1000 + i, words(rng, int(rng.integers(0, 30))) + " " + edited(rng, base, int(rng.integers(0, 6)))) for i in range(60)]
    out += [(2000 + i, edited(rng, out[i % 150][1], 1)) for i in range(100)]
    out += [(3000 + i, out[20][1]) for i in range(30)]
    out += [(4000, None), (4020, ""), (4040, "?!"), (4060, "one"), (4080, "One"), (4100, words(rng, 20000)), (4120, "la " * 9000), (4140, "la " * 9000), (4140, "la " * 9000), (4160, words(rng, 40))]
    return out


def brute(rows, s):
    """All offsets of all pairs."""
    play = ch.Tones(s)
    prints = [ch.fingerprint(play(t), s) for _, t in rows]
    out = {}
    for k, (i, _) in enumerate(rows):
        if i % 20:
            continue
        found = set()
        for m, (j, _) in enumerate(rows):
            a, b = prints[k], prints[m]
            if i != j and len(a) and len(b):
                if len(a) * len(b) > 1 << 21:
                    offsets = [0]
                else:
                    offsets = range(1 - len(b), len(a))
                if a.tobytes() == b.tobytes() or any(ch.matches(a, b, o, s) is not None for o in offsets if min(len(a), len(b) + o) - max(0, o) >= max(s.shortest, s.overlap * min(len(a), len(b)))):
                    found.add(j)
        out[i] = found
    return out


def test_search_against_brute_force(spark, rows):
    s = ch.Settings(block=3000)  # several blocks
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in ch.search(docs.where("doc_id % 20 = 0"), docs, "text", ch.Tones, s).collect()}
    want = brute(rows, s)
    assert set(got) == set(want)
    links = sum(len(x) for x in want.values())
    assert sum(min(got[i]["n_links"], len(x)) for i, x in want.items()) >= 0.9 * links > 100
    assert all(r["best_doc_id"] is None or r["best_doc_id"] in want[i] for i, r in got.items())
    assert all((r["best_doc_id"] is None) == (r["n_links"] == 0) for r in got.values())
    assert all(got[i]["n_links"] == 0 and got[i]["n_prints"] == 0 for i in (4000, 4020, 4040))
    assert got[4060]["best_doc_id"] == 4080 and got[4120]["best_doc_id"] == 4140 and got[20]["best_errors"] == 0


def test_results_do_not_depend_on_blocks_or_partitions(spark, rows):
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in rows if i != 4140], SCHEMA)
    one = ch.search(docs.where("doc_id % 20 = 0"), docs.coalesce(1), "text", ch.Tones).collect()
    many = ch.search(docs.where("doc_id % 20 = 0"), docs.repartition(7), "text", ch.Tones, ch.Settings(block=2000)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_wav_at_an_offset(spark):
    s = ch.Settings(rate=11025, frame=4096, hop=1024)
    rng = np.random.default_rng(2)

    def tune(n):
        t = np.arange(s.hop * 2) / s.rate
        return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in rng.integers(0, 24, n)])

    def data(x):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setparams((1, 2, s.rate, 0, "NONE", ""))
            f.writeframes(np.clip(x, -32000, 32000).astype("<i2").tobytes())
        return bytearray(out.getvalue())

    song = tune(60)
    noisy = song[s.hop * 20 :] + rng.normal(0, 300, len(song) - s.hop * 20)
    rows = [(0, data(song)), (1, data(noisy)), *((i, data(tune(60))) for i in range(2, 8)), (20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, audio binary")
    got = {r["doc_id"]: r for r in ch.search(docs.where("doc_id % 20 = 0"), docs, "audio", lambda: ch.wav, s).collect()}
    assert (got[0]["n_links"], got[0]["best_doc_id"], got[0]["best_offset"]) == (1, 1, 20)
    assert got[20]["n_links"] == 0


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame([(0, "a b", "d", 1)], SCHEMA)
    assert ch.search(docs.limit(0), docs, "text", ch.Tones).count() == 0
    assert [r["n_links"] for r in ch.search(docs, docs.limit(0), "text", ch.Tones).collect()] == [0]


def test_every_partner_is_counted_and_named(spark):
    rng = np.random.default_rng(9)
    one = words(rng, 120)
    rows = [(i, one) for i in range(1, 61)] + [(60, one), (200, edited(rng, one, 1)), (201, edited(rng, one, 1)), (220, words(rng, 90)), (240, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, ch.Settings())
    for parts, held in ((1, 200_000), (5, 2)):
        got = {(r["doc_id"], i): r for i, r in enumerate(ch.search(docs.where("doc_id % 20 = 0"), docs.repartition(parts), "text", ch.Tones, ch.Settings(held=held)).collect())}
        members = {}
        for r in ch.classes(docs, "text", ch.Tones).collect():
            members.setdefault(r["class"], []).append(r["doc_id"])
        assert sorted(i for x in members.values() for i in x) == sorted(i for i, t in rows if t)
        assert len(got) == 7
        for (i, _), r in got.items():
            partners = [d for link in r["links"] for d in members[link["class"]] if d != i]
            assert len({link["class"] for link in r["links"]}) == len(r["links"])
            assert set(partners) == want[i] and len(partners) == r["n_links"] == sum(j in want[i] for j, _ in rows)


def test_pairs_with_one_landmark_or_none_voted_twice_are_found(spark):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(80):
        text = words(rng, 100)
        rows += [(20 * i, text), (20 * i + 1, edited(rng, text, 15))]
    want = brute(rows, ch.Settings())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ch.search(docs.where("doc_id % 20 = 0"), docs, "text", ch.Tones).collect()}
    assert all(got[i] <= len(x) for i, x in want.items())
    assert sum(got.values()) >= 0.9 * sum(map(len, want.values())) > 60
