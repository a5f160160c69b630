"""Each operator against a brute-force version or a round trip, and on odd tables."""

import collections
import functools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import class_ngrams, jaccard_join, language_mixture, line_frequency, one_bit_search, packing, passage_chains, piece_lattice, sharding, toxicity_grammar
from millrace.llm.common import lower_words_of

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, n long, word string"


def prose(seed: int, n: int, lang: str = "en") -> str:
    words = {"en": "the of and to in that is was for it with as his on be at by had not are".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au".split()}[lang]
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words) + (r.choice(["", "ing", "ly", "ed"]) if lang == "en" else r.choice(["", "é", "aux", "ment"])) + str(r.integers(30)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(i, 60 + 7 * (i % 9)) for i in range(30)]
    near = [" ".join(w if j != 20 else "changed" for j, w in enumerate(t.split())) for t in base[:6]]
    shared = prose(99, 70)
    texts = [*base, *base[:4], *near, base[7] + " " + shared, shared + "\n" + base[8], base[9] + "\n" + shared + "\nend of it", None, "", "   ", "one", "one", "x " * 400, "a\nb\nsame line here\nsame line here", *[prose(200 + i, 80, "fr") for i in range(8)]]
    rows = [(i, t, "fr" if i >= len(texts) - 8 else "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 0.5, 2, "w") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_sharding(docs):
    out = sharding.jump_shards(docs.drop("shard").select("doc_id", "text"), ["doc_id"], 8, order=["text"]).collect()
    assert len(out) == docs.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    keys = np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)
    a, b = sharding.jump_hash(keys, 10), sharding.jump_hash(keys, 11)
    assert ((a == b) | (b == 10)).all() and 0.06 < (a != b).mean() < 0.12
    assert sharding.jump_shards(docs.where("false").select("doc_id"), ["doc_id"], 8).count() == 0


def test_line_quality(spark, docs, local):
    out = collections.defaultdict(list)
    for r in line_frequency.line_quality(docs).collect():
        out[r.doc_id].append(r)
    for d, t in local:
        w = WORD.findall(t or "")
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(runs)
        inside = {j for i, s in enumerate(runs) if c[s] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        for r in out[d]:
            assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside))
            assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
    rows = [(i, f"Shared  LINE of the host number one\n{prose(i, 20)}", "h") for i in range(30)] + [(99, "shared line of the host number one\nshared line of the host number one", "h"), (100, "shared line of the host number one " * 1 + "\n" + prose(3, 15), "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency.line_quality(df, with_text=True).collect()}
    assert all(got[i].kept and got[i].n_removed_lines == 1 and "LINE" not in got[i].cleaned_text for i in range(30))
    assert not got[99].kept and got[99].n_removed_words == 14 and got[100].n_removed_lines == 0
    assert line_frequency.line_quality(df.where("false")).count() == 0


def test_lines_of_a_large_host(spark):
    rows = [(i, (f"Read more of this on our site\n" if i % 20 == 0 else "") + prose(1000 + i, 25), "h") for i in range(600)]
    page = f"Copied line of words\n{prose(2000, 30)}"
    rows += [(1000 + i, page, "c") for i in range(30)] + [(2000, page, "r")] * 30 + [(3000 + i, f"in a few places only\n{prose(3000 + i, 25)}", "h") for i in range(20)]
    got = line_frequency.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in got:
        assert r.n_removed_lines == (2 if 1000 <= r.doc_id < 2000 else int(r.doc_id < 600 and r.doc_id % 20 == 0))
    assert len(got) == len(rows)


def test_toxicity(spark):
    machine = toxicity_grammar.grammar()
    model = toxicity_grammar.ToxicityModel({"fool": 4.0, "dolt*": 4.0}, machine=machine)
    s = lambda t: sum(model.clauses(t))
    assert s("what a fool") == 4 and s("you fool") == 6 and s("this is not a fool") == 1 and s('he said "fool" there') < 4
    assert s("") == s(None) == s("a calm text. kill the lights") == 0 and s("they kill you") > 0 and s("doltish talk") == 4
    rows = [(i, prose(i, 40) + (f" you fool{'ish' * (i % 2)} go." if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity_grammar.fit(df.where("doc_id < 80"), df.where("doc_id < 80").select("doc_id", "toxic"))
    out = toxicity_grammar.score(df.unionByName(spark.createDataFrame([(500, None, 0), (501, "", 0)], df.schema)), fitted, keep=["doc_id", "toxic"]).collect()
    assert all(r.predicted == r.toxic and 0 <= r.score <= 1 for r in out)
    none = toxicity_grammar.fit(df, df.where("false"))
    assert toxicity_grammar.score(df, none).where("predicted = 1").count() == 0


def test_toxicity_memory():
    """A score doesn't depend on what was read before, nor on how many words are remembered."""
    texts = [f"{prose(i, 30)} you fool {i} word{i}. he said fool" for i in range(20)] + ["you fool you fool. are bad. ..."]
    fresh = [toxicity_grammar.ToxicityModel({"fool": 4.0}).clauses(t) for t in texts]
    for most in (0, 1, 50, 400_000):
        model = toxicity_grammar.ToxicityModel({"fool": 4.0}, most=most)
        assert [model.clauses(t) for t in texts] == fresh
        assert [model.clauses(t) for t in reversed(texts)] == fresh[::-1]
    assert fresh[-1] == [12.0]


def test_learned_threats(spark):
    """A word that is toxic only after a target is learned as a threat."""
    rows = [(i, prose(i, 30) + (f" we will zork you{i}. now they zork them." if i % 4 == 0 else f" the zork is on {i}."), int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_grammar.fit(df, df.select("doc_id", "toxic"))
    assert "zork" in model.threats and "zork" not in model.weights
    assert model.clauses("they zork us") and not model.clauses("a zork is here")


def test_jaccard(docs, local):
    for k, percent in ((4, 85), (5, 80)):
        sets = {}
        for d, t in local:
            w = lower_words_of(t)
            sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        root = {d: d for d in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = jaccard_join.jaccard_components(docs, k=k, percent=percent).collect()
        assert len(got) == len(local)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), find(d)) for d, s in sets.items()}
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0


def test_jaccard_links(spark):
    base = [prose(700 + i, 120).split() for i in range(3)]
    texts = []
    for b, copies in zip(base, (40, 3, 5), strict=True):
        for c in range(copies):
            r = np.random.default_rng(len(texts))
            w = list(b)
            for at in r.choice(120, int(r.integers(0, 4)), replace=False):
                w[at] = f"own{len(texts)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[41], None, "", "alone"]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    sets = []
    for t in texts:
        w = lower_words_of(t)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    want = [sum(a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for b in range(len(sets)) if sets[a] and sets[b]) for a in range(len(sets))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=key) == sorted(((d, len(s), n) for (d, _), s, n in zip(rows, sets, want, strict=True)), key=key)
    assert max(want) > 10
    r = np.random.default_rng(3)
    many = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(50)]
    brute = np.array([[100 * len(np.intersect1d(x, y)) >= 50 * len(np.union1d(x, y)) for y in many] for x in many])
    assert all((jaccard_join.linked(many, many, 50, step=s) == brute).all() for s in (7, 2048)) and 0 < brute.mean() < 1


def test_jaccard_links_in_blocks(spark, monkeypatch):
    base = prose(800, 90).split()
    df = spark.createDataFrame([(i, " ".join([*base, f"end{i % 20}"])) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "_linked_in_classes", functools.partial(jaccard_join._linked_in_classes, block=4))
    assert {r.n_links for r in jaccard_join.jaccard_components(df, block=3).collect()} == {29}
    # one large group, in which many sets are linked with few others and some with none
    r = np.random.default_rng(5)
    texts = []
    for i in range(80):
        w = list(base)
        for at in r.choice(90, int(r.integers(0, 9)), replace=False):
            w[at] = f"own{r.integers(3) if i % 2 else i}"
        texts.append(" ".join(w))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in map(str.split, texts)]
    ok = np.array([[100 * len(x & y) >= 85 * len(x | y) for y in sets] for x in sets])
    first = jaccard_join.first_of_component(ok)
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8).collect()
    assert {(x.doc_id, x.component_id, x.n_links) for x in got} == {(i, int(first[i]), int(ok[i].sum()) - 1) for i in range(80)}
    assert 3 < len(set(first.tolist())) < 75


def test_pipeline_stages(spark):
    import corpus_pipeline

    base = [prose(900 + i, 90) for i in range(8)]
    near = [f"{t} end" for t in base]
    shared = prose(950, 80)
    rows = [(None, base[0]), (None, base[1]), (None, near[1]), (5, base[2]), (5, base[3]), (5, base[3]), (9, near[0]), (3, near[2]), (6, ""), (7, None), (None, None)]
    rows += [(20, f"{shared} {base[4]}"), (30, f"{base[5]} {shared}"), (30, base[6]), (None, f"{base[7]} {shared}")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = []
    for _, t in rows:
        w = lower_words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    group = {i: i for i in order}
    for i in order:
        for j in order:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[j], group[i]
                group = {x: new if g == old else g for x, g in group.items()}
    classes = collections.defaultdict(list)
    for i in order:
        classes[group[i]].append(i)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # of base[1] and its near copy neither has an id: either may stay
    free = {(None, near[1]): (None, base[1])}
    assert collections.Counter(free.get(r, r) for r in got) == collections.Counter(free.get(rows[c[0]], rows[c[0]]) for c in classes.values())
    cut = collections.Counter((r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.passages(spark, kept, "").collect())
    assert sum(cut.values()) == len(got)
    assert cut[(20, f"{shared} {base[4]}")] == cut[(30, base[5])] == cut[(30, base[6])] == cut[(None, base[7])] == cut[(5, base[3])] == 1


def test_tiles_meet():
    r = np.random.default_rng(5)
    for n in (7, 13, 40, 129, 700):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(r.integers(0, max(1, int(0.15 * n)) + 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, 3))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert jaccard_join.apart_at_least(jaccard_join.signature(a), jaccard_join.signature(b)) <= len(a) + len(b) - 2 * both
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) != both:
                assert np.intersect1d(jaccard_join.tile_keys(a, 85, 100), jaccard_join.tile_keys(b, 85, 100)).size


def test_language(docs):
    model = language_mixture.fit(docs.where("doc_id % 2 = 0"))
    out = language_mixture.identify(docs, model, keep=["doc_id", "text", "lang"]).collect()
    for r in out:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(r.text) > 200:
            assert r.lang_pred == r.lang
    mixed = language_mixture.identify(docs.limit(1).select(F.lit(prose(1, 60) + "\n" + prose(2, 60, "fr")).alias("text")), model, keep=[]).first()
    assert sorted(mixed.langs) == ["en", "fr"] and 0.3 < mixed.score < 0.7
    assert language_mixture.identify(docs, language_mixture.fit(docs.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_passages(docs, local):
    spans = passage_chains.repeated_passages(docs).collect()
    covered = collections.defaultdict(set)
    for r in spans:
        assert r.first_id < r.doc_id and r.end_word - r.start_word >= 50
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    seen = set()
    for d, t in sorted(dict(local).items()):
        w = lower_words_of(t)
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, s in enumerate(runs):
            if s in seen:
                assert len(covered[d] & set(range(i, i + 50))) > 45
        seen |= set(runs)
    assert not any(d < 30 for d in covered)
    cut = {r.doc_id: r.text for r in passage_chains.cut_passages(docs, passage_chains.repeated_passages(docs)).collect()}
    assert cut[0] == dict(local)[0] and len(lower_words_of(cut[30])) < 5 and "end of it" in cut[42]
    x, y = np.array([0, 10, 20, 500]), np.array([5, 15, 25, 2])
    assert [sorted(c.tolist()) for c in passage_chains.chains(x, y, 6)][0] == [0, 1, 2]
    assert passage_chains.repeated_passages(docs.where("false")).count() == 0


def test_passages_far_apart(spark):
    one, two = prose(501, 400), prose(502, 300)
    rows = [(1, f"{one} {prose(503, 80)} {two}"), (2, f"{one} {prose(504, 80)} {two}"), (3, f"{prose(505, 30)} {one} {prose(506, 200)} {two}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places = {1: [(0, 400), (480, 780)], 2: [(0, 400), (480, 780)], 3: [(30, 430), (630, 930)]}
    spans = passage_chains.repeated_passages(df).collect()
    for d in (2, 3):
        got = sorted((r.start_word, r.end_word, r.first_id, r.first_start, r.first_end) for r in spans if r.doc_id == d)
        assert len(got) == 2
        for (s, e), (fs, fe), r in zip(places[d], places[1], got, strict=True):
            assert r[2] == 1 and np.abs(np.array([r[0] - s, r[1] - e, r[3] - fs, r[4] - fe])).max() <= 2
    k, step = 6, np.arange(0, 300, 7)
    x, y = np.concatenate([step, step + 400]), np.concatenate([step, step + 400])
    assert sorted(len(c) for c in passage_chains.chains(x, y, k)) == [len(step)] * 2


def test_passages_seen_in_parts(spark):
    """Two halves that are too short alone stand apart in earlier documents; the whole repeats only later."""
    one, two = prose(601, 40), prose(602, 40)
    rows = [(10, f"{prose(603, 30)} {one} {prose(604, 30)}"), (11, f"{prose(605, 30)} {two}"), (12, f"{prose(606, 20)} {one} {two}"), (13, f"{one} {two} {prose(607, 25)}")]
    spans = [r for r in passage_chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id == 13]
    assert [(r.first_id, r.start_word, r.end_word) for r in spans] == [(12, 0, 80)]


def chained_by_force(x, y, k, gap, max_gap):
    """Best chain score that ends in each match, over all predecessors within ``max_gap``."""
    score = np.full(len(x), float(k))
    for j in np.lexsort((y, x)):
        for i in np.lexsort((y, x)):
            dx, dy = x[j] - x[i], y[j] - y[i]
            if dx > 0 and dy > 0 and max(dx, dy) <= max_gap + k:
                cover = min(k, dx, dy)
                score[j] = max(score[j], score[i] + cover - gap * ((dx - cover) + (dy - cover)) / 2)
    return score


def test_passages_behind_two_holders(spark):
    """The halves stand apart in two earlier documents each, so no seed of the whole has its holder among its first two; nor has a line that repeats itself."""
    one, two, line = prose(611, 40), prose(612, 40), prose(613, 9)
    texts = [f"{prose(614 + i, 30)} {half} {prose(624 + i, 30)}" for i, half in enumerate([one, one, one, two, two, two])]
    texts += [f"{prose(634, 20)} {one} {two}", f"{one} {two} {prose(635, 25)}", f"{prose(636, 30)} {' '.join([line] * 12)}", f"{prose(637, 40)} {' '.join([line] * 10)} {prose(638, 30)}"]
    spans = passage_chains.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.first_id, r.start_word, r.end_word, r.first_start, r.first_end) for r in spans if r.doc_id == 7] == [(6, 0, 80, 20, 100)]
    assert set().union(*(range(r.start_word, r.end_word) for r in spans if r.doc_id == 9 and r.first_id == 8)) == set(range(40, 130))
    assert {r.doc_id for r in spans} == {7, 9}


def test_open_starts():
    """No start of a repeated run is left out, against all runs by force."""
    r = np.random.default_rng(5)
    for _ in range(20):
        run = r.integers(0, 1 << 62, 44).astype(np.uint64)  # hashes of the 45 places of a 50-word run less one
        sides = [np.concatenate([r.integers(0, 1 << 62, int(r.integers(0, 60))).astype(np.uint64), run, r.integers(0, 1 << 62, int(r.integers(0, 60))).astype(np.uint64)]) for _ in range(2)]
        picked = [passage_chains.seeds(h, 12) for h in sides]
        for h, p, other, q in [(sides[0], picked[0], sides[1], picked[1]), (sides[1], picked[1], sides[0], picked[0])]:
            shared = np.isin(h[p], other[q])
            start = int(np.flatnonzero(h == run[0])[0])
            assert any(lo <= start <= hi for lo, hi in passage_chains.open_starts(p, shared, shared, 6, 12, 49))


def test_chains_reach_the_best_score():
    r = np.random.default_rng(11)
    for _ in range(60):
        n = int(r.integers(2, 40))
        pairs = np.unique(r.integers(0, 160, (n, 2)), axis=0)
        x, y = pairs[:, 0], pairs[:, 1]
        best = chained_by_force(x, y, 6, 0.5, 60).max()
        first = passage_chains.chains(x, y, 6)[0]
        got = 6.0
        for i, j in zip(first[:-1], first[1:], strict=True):
            dx, dy = x[j] - x[i], y[j] - y[i]
            assert dx > 0 and dy > 0 and max(dx, dy) <= 66
            cover = min(6, dx, dy)
            got += cover - 0.25 * ((dx - cover) + (dy - cover))
        assert got == pytest.approx(best)


def test_packing(docs, local):
    from tokenizers import Tokenizer

    long = docs.limit(1).select(F.lit(1000).cast("long").alias("doc_id"), F.repeat(F.lit("many words in a row "), 3000).alias("text"))
    df = docs.select("doc_id", "text").unionByName(long)
    out = packing.pack(packing.pieces(df, P.path("byte_bpe_50k.json"), P.PATTERN)).toPandas()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d, s in {**dict(local), 1000: "many words in a row " * 3000}.items():
        ids = np.array(t.encode(s or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id == d]
        assert mine.length.sum() == len(ids) * (len(mine[mine.start == 0]))
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in mine.itertuples())
    g = out.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 2048
    sizes, demand = np.arange(1, 65), np.full(64, 500)
    plan = packing.column_generation(sizes, demand, 64)
    assert (sum(n * c for n, c in plan) == demand).all() and sum(n for n, _ in plan) <= 1.01 * (sizes * demand).sum() / 64 + 1
    assert packing.pack(packing.pieces(df.where("false"), P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def test_class_ngrams(docs, local):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = collections.Counter()
    for d, t in local:
        if not held(d):
            c.update([*lower_words_of(t), b""])
    n, v = sum(c.values()), len(c)
    rows = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 10 == 0).select("doc_id", "text", "held")
    for head in (1 << 18, 40):
        model, counts = class_ngrams.fit(rows.where("not held"), items=32, groups=8, classes=12, head=head)
        for r in class_ngrams.score(rows, model, counts, keep=["doc_id"]).collect():
            w = [*lower_words_of(dict(local)[r.doc_id]), b""]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert np.isclose(r.base_score, sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            assert np.isfinite(r.score) and r.score < 0
        assert np.allclose((10**model.transition).sum(axis=1), 1)
    empty = rows.where("false")
    model, counts = class_ngrams.fit(empty)
    assert class_ngrams.score(rows, model, counts, keep=["doc_id"]).where("n_known > 0").count() == 0


def test_class_ngrams_end_beyond_the_head(spark):
    """The end of a text is counted where more words than ``head`` are more frequent than it; a small head scores as a large one."""
    rows = [(i, " ".join(f"w{j % (9 + i)} v{j % 7}" for j in range(120))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = collections.Counter(w for _, t in rows for w in [*lower_words_of(t), b""])
    n, v = sum(c.values()), len(c)
    scores = []
    for head in (1 << 18, 12, 5):
        model, counts = class_ngrams.fit(df, items=5, groups=4, classes=4, head=head)
        assert model.count[model.ids[b""]] == 3
        got = class_ngrams.score(df, model, counts, keep=["doc_id"]).orderBy("doc_id").collect()
        for r, (_, t) in zip(got, rows, strict=True):
            w = [*lower_words_of(t), b""]
            assert (r.n_tokens, r.n_known) == (len(w), len(w))
            assert np.isclose(r.base_score, sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        scores.append([r.score for r in got])
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


def test_pieces(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [(900, "  two  blanks\n\ttab 日本語 🙂 é " + "q" * 70 + " end "), (901, "Zürich-" * 30), (902, " ".join(f"w{i}x" for i in range(40_000)))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for head in (1 << 18, 5):
        out = piece_lattice.encode_documents(df, piece_lattice.load(path), head=head).collect()
        assert len(out) == df.count()
        for r in out:
            ids = sp.encode(texts[r.doc_id])
            assert r.ids == ids and r.n_pieces == len(ids) and r.id_sum == sum(ids) and r.decodes and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert piece_lattice.encode_documents(df.where("false"), piece_lattice.load(path)).count() == 0


def test_long_pieces(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = np.random.default_rng(8)
    texts = ["=" * n for n in (59, 60, 61, 62, 63, 64, 80, 130, 150)]
    texts += ["-" * 100, "a" * 130, "".join(r.choice(list("etaoinshrdlu"), 120)), "x " + "=" * 61 + " y", "-" * 3000, "é" * 90, "🙂" * 70, "ab" * 100, "ab" * 31 + "日" + "=" * 75, " " * 100 + "x", "-" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in piece_lattice.encode_documents(df, piece_lattice.load(path)).collect():
        assert x.ids == sp.encode(texts[x.doc_id]) and x.decodes


def test_units_are_cut_where_no_piece_spans(monkeypatch):
    model = piece_lattice.load(P.path("piece_bpe_32k.model"))
    text = " ".join([prose(31, 200), "日本語", "=" * 300, "Zürich, a.b-c"])
    units = model.units(text)
    whole = (piece_lattice.MARK + text).replace(" ", piece_lattice.MARK)
    assert "".join(units) == whole
    at, borders = 0, set()
    for u in units:
        borders.add(at)
        at += len(u)
    for s in range(len(whole)):
        for n in range(2, model.longest + 1):
            if whole[s : s + n] in model.table:
                assert not borders & set(range(s + 1, s + n))
    monkeypatch.setattr(piece_lattice, "BLOCK", 16)
    assert "".join(model.units(text)) == whole and model.units(text) == units


def test_viterbi_of_a_unigram_model(spark):
    """The fold's path has the greatest score of all segmentations, characters without a piece counted as unknown."""
    r = np.random.default_rng(4)
    pieces = sorted({"".join(r.choice(list("▁abc"), int(r.integers(1, 5)))) for _ in range(60)} | {"▁"})
    model = piece_lattice.PieceModel(tuple((p, 300 + i, float(np.float32(-r.integers(1, 200) / 16))) for i, p in enumerate(pieces)), 3, "unigram")
    texts = ["".join(r.choice(list("aabbccd "), int(r.integers(0, 50)))) for _ in range(60)] + ["abc" * 60, None, ""]

    def best(word):
        top = [(0.0, [])]
        for e in range(1, len(word) + 1):
            ways = []
            for s in range(e):
                if (p := word[s:e]) in model.table or s == e - 1:
                    ways.append((top[s][0] + (model.table[p][1] if p in model.table else piece_lattice.UNKNOWN), [*top[s][1], p]))
            top.append(max(ways, key=lambda x: x[0]))
        return top[-1]

    def total(ids):
        names = {i: s for _, i, s in model.rows}
        return sum(names.get(i, piece_lattice.UNKNOWN) for i in ids)

    for x in piece_lattice.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect():
        word = (piece_lattice.MARK + texts[x.doc_id]).replace(" ", piece_lattice.MARK) if texts[x.doc_id] else ""
        unknown = sum(c not in model.table for c in best(word)[1])
        assert x.decodes and total(i for i in x.ids if i >= 300) + unknown * piece_lattice.UNKNOWN == pytest.approx(best(word)[0])


def test_pieces_query(spark, docs, tmp_path):
    import sentencepiece

    from millrace.llm import queries

    odd = spark.createDataFrame([(900, "a b c"), (901, "c b a"), (902, "tab\tnew\nline 日本語 🙂 "), (903, "its own ▁ mark"), (None, "no key")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    out = queries.op9_piece_lattice(spark, str(tmp_path)).collect()
    assert len(out) == df.count()
    for r in out:
        ids = sp.encode(texts[r.doc_id])
        assert (r.ids, r.n_pieces, r.id_sum, r.decodes) == (ids, len(ids), sum(ids), r.doc_id != 903)


def test_search(spark):
    v = np.random.default_rng(1).standard_normal((1500, 24))
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]
    rows += [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0] * 3), (None, rows[1][1]), (7, rows[7][1]), (6000, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in one_bit_search.nearest(df, every=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, x) for i, x in rows if i is not None and (i < 1500 or i == 6000)]
    ids, a = np.array([i for i, _ in good]), np.array([x for _, x in good])
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    hit = total = 0
    for q in sorted({i for i in ids if i % 50 == 0}):
        s = u @ u[np.flatnonzero(ids == q)[0]]
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q]
        best = list(dict.fromkeys(best))[:5]
        hit += len(set(best) & {i for i, _ in got[q]})
        total += 5
        assert len(got[q]) == 5 and all(abs(x - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, x in got[q])
    assert set(got) == {int(i) for i in ids if i % 50 == 0} and hit / total > 0.97
    assert one_bit_search.nearest(df.where("false")).count() == 0


def test_pipeline_filters_and_packing(spark, tmp_path):
    """The filters keep and drop what a language and toxicity label say; packing holds every token of what is left once."""
    import corpus_pipeline

    rows = [(i, prose(1200 + i, 60, "fr" if i % 3 == 0 else "en") + (" you fool go." if i % 5 == 0 else ""), "fr" if i % 3 == 0 else "en", "s", 0) for i in range(150)]
    rows += [(500, "12 34 ;;", None, "s", 0), (501, "", "en", "s", 0), (None, prose(1500, 50), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([*range(150), None])
    clean = corpus_pipeline.toxicity(spark, kept, str(tmp_path))
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter([i for i in range(150) if i % 5] + [None])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.sequences(spark, clean, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.length.sum() == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame(stage(spark, empty, str(tmp_path)).collect(), docs.schema) if stage is not corpus_pipeline.sequences else stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ("see <|endoftext|> here", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n", "<|endof", "plain"):
        assert packing.token_ids(P.path("byte_bpe_50k.json"), P.PATTERN, text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_language_mixtures(spark):
    """Two halves in two languages give both, with shares near a half; the shares are where EM over the words' likelihoods ends."""
    train = spark.createDataFrame([(i, prose(1600 + i, 80, "fr" if i % 2 else "en"), "fr" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model = language_mixture.fit(train)
    text = f"{prose(1700, 120, 'en')} {prose(1701, 120, 'fr')}"
    got = language_mixture.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert set(got.langs) == {"en", "fr"} and abs(got.score - 0.5) < 0.1
    like = np.exp(model.word_scores(text) - model.word_scores(text).max(axis=1, keepdims=True))
    pi = np.array([0.5, 0.5])
    for _ in range(200):
        pi = (like * pi / (like * pi).sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(dict(zip(got.langs, got.shares, strict=True))["en"], pi[model.langs.index("en")], atol=0.01)
