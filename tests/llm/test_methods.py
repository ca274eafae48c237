"""The operators' methods against brute force, exact round trips or held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from gramwell.llm import decontamination, jaccard_join, license_scans, media_columns, packing, secret_scans, suffix_dedup, token_counts, tokens, toxicity, url_filters
from hypothesis import given, settings
from hypothesis import strategies as st


# --- 1


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once(histogram):
    slots = packing.plan(histogram, 64)
    ranks: dict[int, list[int]] = {}
    cells: dict[int, list[tuple[int, int]]] = {}
    for length, first, count, sequence, offset in slots:
        ranks.setdefault(length, []).extend(range(first, first + count))
        for k in range(count):
            cells.setdefault(sequence + k, []).append((offset, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
    assert sorted(cells) == list(range(len(cells)))
    for own in cells.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    best = 0
    gaps: list[int] = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            best += 1
            gaps.append(64 - x)
    assert len(cells) <= best


def test_exact_complements():
    assert packing.fill(np.bincount([10, 20, 30], minlength=65), 30, 64, 3) == (30,)
    assert packing.fill(np.bincount([10, 20], minlength=65), 30, 64, 3) == (20, 10)
    assert packing.fill(np.bincount([10, 10, 10], minlength=65), 30, 64, 3) == (10, 10, 10)
    assert packing.fill(np.bincount([10, 10], minlength=65), 30, 64, 3) is None
    assert len({s[3] for s in packing.plan({60: 1, 40: 1, 24: 1, 4: 1}, 64)}) == 2


@given(st.text(alphabet=st.sampled_from("ab  \n\té.,²ªʰ̈'sß.1 　\x1c"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_gives_the_tokenizers_ids(text):
    e = tokens.encoder(tokens.default_vocabulary())
    assert np.frombuffer(e.encode(text), "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_text():
    e = tokens.encoder(tokens.default_vocabulary())
    assert 50256 not in np.frombuffer(e.encode("x <|endoftext|> y"), "<u2")


# --- 2


def test_secret_kinds():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = secret_scans.DIGITS[d] + digits
    good, bad = f"ghp_{body}{digits}", f"ghp_{body}{'0' * 6 if digits != '0' * 6 else '1' * 6}"
    kinds = lambda t: [k for k, _, _ in secret_scans.find_secrets(t)]
    assert kinds(good) == ["checked"] and kinds(bad) == []
    assert kinds("PassWord: 'hunter22'") == ["assign"] and kinds("password: 'short'") == [] and kinds("paſſword=abcdef") == []
    assert kinds("AKIA" + "A" * 16) == ["access"] and kinds("AKIA" + "A" * 15) == []
    assert kinds("f" * 24) == ["hex"] and kinds("f" * 23) == []
    assert kinds("token=" + "a" * 24) == ["assign", "hex"]
    assert secret_scans.find_secrets("é token=abcdef") == [("assign", 2, 14)]
    assert secret_scans.redacted("x token=abcdef y", [("assign", 2, 14)]) == "x [assign] y"


@given(st.text(alphabet=st.sampled_from("tokenpasswdAPI_KEYaf09 =:'\"é\nİK"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_assign_is_the_plain_search(text):
    want = [(m.start(), m.end()) for m in secret_scans.ASSIGN.finditer(text) if len(m[2]) >= 6]
    assert [(s, e) for k, s, e in secret_scans.find_secrets(text) if k == "assign"] == want
    assert secret_scans.with_hex(pa.array([text, "f" * 24, None, "g" + "0" * 30])).tolist() == [bool(secret_scans.HEX.search(text)), True, False, True]


def test_long_runs_of_token_starts():
    import time

    began = time.perf_counter()
    assert secret_scans.find_secrets("eyJ" * 300_000) == []
    header = "eyJhbGciOiAiSFMyNTYifQ"
    assert [k for k, _, _ in secret_scans.find_secrets(f"eyJeyJ {header}.abc.def {header}.{header}.abc")] == ["jwt", "jwt"]
    assert time.perf_counter() - began < 20


# --- 3


@given(st.lists(st.text(alphabet="ab ", max_size=40), max_size=6), st.lists(st.text(alphabet="ab ", max_size=24), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_wu_manber_finds_all_windows(texts, items):
    window = 3
    patterns = decontamination.Patterns.of([(str(i), t) for i, t in enumerate(items)], window)
    n, hit, found, _ = decontamination.matches(patterns, pa.array(texts, pa.string()))
    wanted_hits, wanted_items = [], []
    for t in texts:
        words, mark, own = t.split(), set(), set()
        for k, item in enumerate(items):
            w = item.split()
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == w[i : i + m]:
                        mark |= set(range(j, j + m))
                        own.add(k)
        wanted_hits += [i in mark for i in range(len(words))]
        wanted_items.append(own)
    assert n.tolist() == [len(t.split()) for t in texts]
    assert hit.tolist() == wanted_hits and found == wanted_items


def test_parts_of_a_benchmark_give_the_same(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(n))
    items = [(i, text(20)) for i in range(12)]
    docs = [(i, text(30) + " " + items[i % 12][1] + " " + items[(i + 5) % 12][1]) for i in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontamination.find_items(d, b, keep=("doc_id",)).collect()))
    assert one == sorted(map(str, decontamination.find_items(d, b, keep=("doc_id",), max_window_words=100).collect()))


# --- 4


@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=8))
@settings(max_examples=120, deadline=None)
def test_anchors_agree_on_equal_strings(texts):
    span, gram = 12, 4
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    a, _, first, count, own = suffix_dedup.anchors(data, offs, span, gram)
    place = {}
    for k in range(len(a)):
        for p in range(first[k], first[k] + count[k]):
            assert offs[own[k]] <= p and p + span <= offs[own[k] + 1]
            assert place.setdefault(data[p : p + span].tobytes(), a[k]) == a[k]
    assert count.sum() == sum(max(0, len(t) - span + 1) for t in texts)


def test_family_levels_grow_geometrically():
    family, rng = suffix_dedup.Family(), np.random.default_rng(0)
    for k in range(40):
        e = np.zeros(10, suffix_dedup.ENTRY)
        e["a"] = rng.integers(0, 2**63, 10, dtype=np.uint64)
        e["id"] = k
        assert not len(family.insert(e))
    assert len(family.levels) <= 7 and all(len(x) > len(y) for x, y in zip(family.levels, family.levels[1:], strict=False))
    copies = family.levels[0][:5].copy()
    again = copies.copy()
    copies["id"] += 1_000  # equal strings at other places repeat; rows given twice are one
    found = len(family.insert(copies))
    assert not len(family.insert(again))
    index, repeats = family.settle()
    assert found + len(repeats) == 5 and len(index) == 400


def brute_removed(rows, span):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        cover = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if b[i : i + span] in seen:
                cover[i : i + span] = b"\1" * span
            seen.add(b[i : i + span])
        out[d] = bytes(c for c, m in zip(b, cover, strict=True) if not m)
    return out


@pytest.mark.parametrize("many", [20_000, 1])
def test_removed_bytes(spark, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY_CONTEXTS", many)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcd") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 200))) + (passage[: rng.randint(20, 90)] if i % 2 else "") + "x" * (i % 60)) for i in range(60)]
    rows += [(100 + i, rows[i][1][:150] + "!" + rows[i][1][150:]) for i in range(20)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span=20, gram=6).collect()}
    assert got == brute_removed(rows, 20)


# --- 5


def test_blocks_are_stitched(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, 5000).astype("<u2")
    ids[rng.random(5000) < 0.004] = 50256
    for name, n in (("a", 5000), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.bin").write_bytes(ids[:n].tobytes())
    files = spark.createDataFrame([(str(tmp_path / f"{n}.bin"), s * 2) for n, s in (("a", 5000), ("b", 3), ("c", 0))], "file string, size long")
    for block in (64, 1 << 20):
        got = token_counts.scan_token_files(files, block_bytes=block).collect()
        for name, n in (("a", 5000), ("b", 3), ("c", 0)):
            ends = np.flatnonzero(ids[:n] == 50256)
            want = (np.diff(np.concatenate([[-1], ends])) - 1).tolist()
            tail = n - (int(ends[-1]) + 1 if len(ends) else 0)
            own = sorted((r["ordinal"], r["n_tokens"], r["closed"]) for r in got if r["file"].endswith(f"{name}.bin"))
            assert own == [(i, x, True) for i, x in enumerate(want)] + ([(len(want), tail, False)] if tail else [])


# --- 6


@given(st.binary(max_size=500))
@settings(max_examples=100, deadline=None)
def test_png_round_trip(data):
    payload = media_columns.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, len(data)) and len(payload) - len(data) <= 64
    assert media_columns.from_png(media_columns.to_png(payload)) == payload


def test_damage_is_noticed():
    media = bytearray(media_columns.to_png(bytes(64)))
    media[45] ^= 1
    with pytest.raises(ValueError):
        media_columns.from_png(bytes(media))


def test_interleaved_parts_keep_order_and_captions():
    html = "<p>one <b>two</b></p><script>x</script><figure><img src='sha256:ab'><figcaption>cap &amp; tion</figcaption></figure>tail<img src='http://x/y.png' alt='alt'><p>end"
    parts = media_columns.parts_of(html)
    assert [(p["position"], p["kind"], p["text"], p["caption"]) for p in parts] == [(0, "text", "one two", None), (1, "media", None, "cap & tion"), (2, "text", "tail", None), (3, "media", None, "alt"), (4, "text", "end", None)]
    assert parts[1]["digest"] == "ab" and len(parts[3]["digest"]) == 64


def test_captions_stay_with_their_figure():
    media = lambda html: [(p["digest"], p["caption"]) for p in media_columns.parts_of(html) if p["kind"] == "media"]
    a, b, c = ("<img src='sha256:%s'>" % x for x in "abc")
    assert media(f"{a}<figure>{b}<figcaption>two</figcaption></figure><figcaption>loose</figcaption>{c}") == [("a", None), ("b", "two"), ("c", None)]
    assert media(f"<figure><figcaption>first</figcaption>{a}{b}</figure>{c}") == [("a", "first"), ("b", "first"), ("c", None)]
    assert media(f"<figure>{a}<figcaption>open") == [("a", "open")]
    text = [p["text"] for p in media_columns.parts_of("<figcaption>loose</figcaption><figure><figcaption>alone</figcaption></figure>x")]
    assert text == ["loose", "alone", "x"]


# --- 7


def test_wrong_labels_do_not_hide_toxic_words():
    rng = random.Random(16)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows = []
    for k in range(600):
        words = [rng.choice(common) for _ in range(rng.randint(30, 120))]
        if k % 3 == 0:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(["grumbo", "vexitor", "snarled", "wretchy"]) + rng.choice(["", "s", "ing"]))
        rows.append((" ".join(words).encode(), int(k % 3 == 0)))
    rng.shuffle(rows)
    model = toxicity.fit([(t, 1 - y if k % 40 == 7 else y) for k, (t, y) in enumerate(rows)])
    d = model.difference()
    said = [model.score(sum(d(w) >= model.threshold for w in own), len(own)) >= toxicity.CUT for own in (toxicity.pieces(t) for t, _ in rows)]
    assert sum(s and y for s, (_, y) in zip(said, rows, strict=True)) >= 180
    assert sum(s and not y for s, (_, y) in zip(said, rows, strict=True)) <= 12


def test_held_out_accuracy():
    rng = random.Random(6)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rude = ["grumbo", "vexitor", "snarled", "wretchy"]

    def text(toxic):
        words = [rng.choice(common) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randint(0, len(words)), rng.choice(rude) + rng.choice(["", "s", "ing"]))
        return " ".join(words).encode()

    rows = [(text(y), y) for y in [0] * 400 + [1] * 200]
    rng.shuffle(rows)
    model = toxicity.fit(rows)
    d, seen = model.difference(), {}
    right = Counter()
    for y in [0] * 60 + [1] * 60:
        own = toxicity.pieces(text(y))
        bad = sum(seen.setdefault(w, d(w)) >= model.threshold for w in own)
        right[y] += (model.score(bad, len(own)) >= toxicity.CUT) == bool(y)
    assert right[0] >= 57 and right[1] >= 48


# --- 8


def test_license_templates(spark):
    texts = ["x\nLicensed under the Apache License, Version 2.0.\ny", "licensed under an apache license version 2 0 and so on " * 30, "cc by cc  BY", "nothing here", "Released under the MIT", "general public\nlicense, GENERAL public license"]
    rows = {r["doc_id"]: r for r in license_scans.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["labels"] == "apache" and rows[0]["score"] == 1.0 and rows[0]["n_base"] == 0
    assert rows[1]["labels"] == "apache" and rows[1]["score"] == 7 / 8
    assert (rows[2]["n_base"], rows[2]["first_word"], rows[2]["last_word"], rows[2]["base_labels"]) == (2, 0, 2, "cc-by")
    assert rows[3]["labels"] == "" and rows[4]["labels"] == "mit"
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"]) == (2, 0, 3)


@pytest.mark.parametrize("width", [20, 79])
def test_wrapped_license_templates(spark, width):
    import textwrap

    whole = [(label, t) for label, t in license_scans.TEMPLATES if len(t) > 60]
    texts = ["Name of the thing\n\n" + "\n".join(start + line for line in textwrap.wrap(t, width)) + "\n\nmore text" for _, t in whole for start in ("", " * ")]
    texts += ["released\nin a year of much rain and little wind under\nthe long shade of trees that no license had", "one word\n" * 40]
    rows = {r["doc_id"]: r for r in license_scans.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    for k in range(2 * len(whole)):
        assert rows[k]["labels"] == whole[k // 2][0] and rows[k]["score"] == 1.0
    assert all(rows[k]["labels"] == "" and rows[k]["score"] == 0.0 for k in range(2 * len(whole), len(texts)))


# --- 9


def plain_components(rows):
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w := t.split()) >= 4 else {tuple(w)} for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_components_of_chains_and_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows, own = [], list(base)
    for i in range(40):  # each a small change of the one before: ends of the chain are far apart
        rows.append((1000 - i, " ".join(own)))
        own[(7 * i) % 200] = f"n{i}"
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    rows += [(3000 + i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60)))) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_long_words_that_polynomials_confuse(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    patterns = decontamination.Patterns.of([("0", one), ("1", other)])
    assert decontamination.matches(patterns, pa.array([one, other, one + "a"]))[2] == [{0}, {1}, set()]


def test_group_of_many_near_copies_and_a_hot_column(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 50)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    line = "this line stands in nearly every text of all".split()
    rows = []
    for i in range(150):  # copies with two or three words changed: some pairs link, some don't
        own = list(base)
        for k in rng.sample(range(60), 2 + i % 2):
            own[k] = f"x{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(own + line)))
    rows += [(1000 + i, " ".join([*(f"y{rng.randint(0, 10**9)}" for _ in range(i % 5)), *line])) for i in range(150)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == plain_components(rows)


def test_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (3, a), (3, b), (7, b), (None, a), (None, None), (9, ""), (9, "one word"), (8, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 37, 3), (3, 37, 3), (3, 37, 3), (7, 37, 3), (None, 37, None), (None, 0, None), (9, 0, 9), (9, 1, 9), (8, 0, 8)], key=repr)


# --- 10


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    universe = [f"key{i}" for i in range(3000)]
    listed = universe[::37]
    cascade = url_filters.Cascade(spark, table(listed), table(universe))
    assert len(cascade.levels) > 1
    assert {r["key"] for r in table(universe).where(cascade.has(F.col("key"))).collect()} == set(listed)
    joined = url_filters.Cascade(spark, table(listed), table(universe), max_filter_bytes=1)
    assert joined.joined
    some = spark.createDataFrame([(0, universe[:80]), (1, [])], "id long, keys array<string>")
    assert {r["id"]: r["found"] for r in joined.listed_of(some, "keys", "found", "id").collect()} == {0: [k for k in universe[:80] if k in listed], 1: []}
