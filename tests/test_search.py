"""Approximate search, many needles, dictionaries, containment by the rarest run."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import ann, containment, dictionary, multimatch, search


@pytest.fixture(scope="module")
def clustered(spark):
    """Unit vectors around some directions, one of them with a third of all rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 30, 3000))
    v = centres[which] + 0.5 * rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), [str(i % 5)] if i % 7 else None) for i, x in enumerate(v.astype(np.float32))]
    return spark.createDataFrame(rows, "id long, embedding array<float>, applies_to array<string>")


def asked(corpus, classes="NULL"):
    return corpus.filter("id % 100 = 0").selectExpr("id AS query_id", "embedding", f"CAST({classes} AS array<string>) AS classes")


def as_rows(df):
    return sorted((r.query_id, r.rank, r.id, r.sim) for r in df.collect())


def test_all_lists_and_candidates_give_the_exact_result(spark, clustered, monkeypatch):
    monkeypatch.setattr(ann, "LIST_BLOCK", 100)  # lists are cut into many cells, the hot one too
    monkeypatch.setattr(ann, "PROBE_BLOCK", 4)
    model = ann.fit(clustered, lists=12)
    whole = ann.Model(model.centres, model.books, 12, 3000)
    lists = ann.index(clustered, model)
    assert lists.count() == 3000 and lists.select("list_id").distinct().count() == 12
    for classes in ("NULL", "array('2')", "CASE WHEN id % 200 = 0 THEN array('1', '3') END"):
        q = asked(clustered, classes)
        assert as_rows(ann.search(clustered, lists, q, whole, 10)) == as_rows(search.topk(clustered, q, 10))
    assert as_rows(ann.search(clustered, lists, asked(clustered), whole, 3, exclude_self=True)) == as_rows(search.topk(clustered, asked(clustered), 3, exclude_self=True))


def test_recall_with_few_lists(spark, clustered, tmp_path):
    ann.save(clustered, ann.fit(clustered), f"file://{tmp_path}/index")
    lists, model = ann.load(spark, f"file://{tmp_path}/index")
    assert model.probes <= len(model.centres) / 3 and model.keep < 500
    for classes in ("NULL", "array('2')"):
        q = asked(clustered, classes)
        (r,) = ann.recall(ann.search(clustered, lists, q, model, 10), search.topk(clustered, q, 10)).collect()
        assert r.wanted == 300 and r.found >= 0.9 * r.wanted


def test_a_search_reads_codes_and_meets_on_lists(spark, clustered, tmp_path):
    """No pass over the vectors of the corpus: phase one reads codes, the vectors are joined by id to the candidates alone."""
    ann.save(clustered, ann.fit(clustered, lists=8), f"file://{tmp_path}/index")
    lists, model = ann.load(spark, f"file://{tmp_path}/index")
    plan = ann.candidates(lists, asked(clustered), model)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: \S+", plan)
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sum("code" in s for s in scans) >= 1 and not any("code" in s and "embedding" in s for s in scans)


def test_an_index_of_little_and_of_nothing(spark, clustered):
    none = clustered.limit(0)
    model = ann.fit(none)
    assert ann.search(none, ann.index(none, model), asked(none), model, 5).count() == 0
    three = clustered.filter("id < 3").unionByName(spark.createDataFrame([(9, None, ["1"])], clustered.schema))
    model = ann.fit(three)
    got = ann.search(three, ann.index(three, model), three.selectExpr("id AS query_id", "embedding", "CAST(NULL AS array<string>) AS classes"), model, 5)
    assert got.count() == 9


def test_mandatory_literals():
    read = {
        r"ab+c": {"ab"}, r"(a|bc)?d": {"d"}, r"x{0,2}yz": {"yz"}, r"\bfoo\b|\bbar\b": {"foo", "bar"}, "a*": None, "": None, "a|": None, r"(?i)Hello\.World": {"hello.world"},
        r"[abc]def(?=zzzz)": {"def"}, "(?:ab|cd)ef?": {"ab", "cd"}, "(?P<n>abc)x": {"abc"}, r"\x41bc": None, r"(a)\1": None, "(?x) a b": None, "größe": {"gr"}, "ab(": None,
        r"[]x]abc": {"abc"}, r"[^]]ab": {"ab"}, "a{3}bcd": {"bcd"}, "(?!no)yes": {"yes"}, r"\d+ kg": {" kg"}, "a(?#note)b": {"ab"},
    }
    assert {p: dictionary.mandatory(p) and set(dictionary.mandatory(p)) for p in read} == read


def random_pattern(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.7 or depth > 1:
            part = rng.choice(["a", "b", "c", "K", "s", r"\.", ".", "[ab]", r"\w", "ı", "É"])
        else:
            part = "(" + rng.choice(["", "?:"]) + "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 3))) + ")"
        counts = ["", "", "?", "{0,1}", "{2}"] if part.startswith("(") else ["", "", "", "?", "*", "+", "{0,1}", "{2}", "+?"]  # no repeats of repeats
        parts.append(part + rng.choice(counts))
    return "".join(parts)


def test_no_match_lacks_its_literals():
    """Whatever a pattern matches holds one of its literals, in the spelling that the automaton reads."""
    rng = random.Random(11)
    held = 0
    for _ in range(1500):
        pattern = random_pattern(rng)
        literals = dictionary.mandatory(pattern)
        for _ in range(4):
            text = "".join(rng.choice("abcKks.ıſİKÉé") for _ in range(rng.randint(0, 6)))
            if re.search(pattern, text, re.IGNORECASE) and literals:
                held += 1
                assert any(x in multimatch.folded(text) for x in literals), (pattern, text, literals)
    assert held > 300


@pytest.mark.parametrize("most", [1 << 24, 400])
def test_dictionaries_of_any_size(spark, monkeypatch, most):
    """Shipped to the tasks or dealt over a grid: the same as trying every pattern on every text."""
    monkeypatch.setattr(multimatch, "MOST_BYTES", most)
    monkeypatch.setattr(multimatch, "TEXT_BLOCK", 300)
    rng = random.Random(4)
    words = ["bank", "Banks", "loan", "loans", "NBFC", "état", "ſome", "x", ""]
    texts = [(i, " ".join(rng.choice(words) for _ in range(6)) if i % 9 else None) for i in range(60)]
    patterns = [(f"t{i}", p) for i, p in enumerate([r"\bbanks?\b", r"\bloan\b", "nbfc", "état", "some", r"x?", r"\w+\s\w+\sx", None, "absent", "(bank|loan)s"])]
    got = dictionary.named(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(patterns, "term_id string, pattern string"))
    want = [(i, t) for i, text in texts for t, p in patterns if text is not None and p is not None and re.search(p, text, re.IGNORECASE)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_a_dictionary_finds_what_the_fixed_classes_find(spark):
    from folioflow import dictionaries as D
    from folioflow.functions.text import scan_entities

    rng = random.Random(2)
    pieces = ["Small Finance Banks", "all SFBs", "urban co-operative bank", "RRB", "NBFCs", "agency banks", "AD category - I", "labs", "arcs", "nothing"]
    texts = spark.createDataFrame([(i, " and ".join(rng.sample(pieces, 3))) for i in range(80)], "text_id long, text string")
    terms = spark.createDataFrame([(name, p) for p, name in D.ENTITY_PATTERNS], "term_id string, pattern string")
    want = texts.select("text_id", F.explode(scan_entities(F.col("text"))).alias("term_id"))
    assert sorted(map(tuple, dictionary.named(texts, terms).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("most", [1 << 24, 200])
def test_containment_equals_every_pair(spark, monkeypatch, most):
    monkeypatch.setattr(multimatch, "MOST_BYTES", most)
    monkeypatch.setattr(multimatch, "TEXT_BLOCK", 2000)
    rng = random.Random(8)
    common = "the same long line stands in very many of all texts"
    texts = [(i, f"{'x' * (i % 3)} {common if i % 3 == 0 else ''} " + " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(30))) for i in range(60)] + [(60, None), (61, "")]
    quotes = [(f"q{n}", texts[rng.randrange(60)][1][(at := rng.randrange(40)) : at + rng.choice([3, 9, 25, 60])]) for n in range(80)]
    quotes += [("hot", common.upper().replace(" ", "  ")), ("none", "alpha beta gamma delta epsilon zeta eta"), ("empty", " "), ("null", None), ("hot too", common[2:-2])]
    plain = lambda t: re.sub(r"\s+", " ", t or "").strip().lower()
    want = sorted({(i, q) for i, t in texts for q, quote in quotes if plain(quote) and plain(quote) in plain(t)})
    got = containment.containment(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(quotes, "q string, text string"), "t", "q")
    assert sorted(map(tuple, got.collect())) == want and ("none" not in {q for _, q in want}) and sum(q == "hot" for _, q in want) == 20


def test_short_quotes_take_one_pass(spark):
    """Thousands of short quotes are one scan of the texts, not one for every few hundred."""
    texts = spark.range(40).selectExpr("id AS t", "concat('text ', id, ' of many') AS text")
    quotes = spark.range(3000).selectExpr("id AS q", "concat('EXT ', id) AS text")
    got = containment.containment(texts, quotes, "t", "q")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 40") == 1 and "Union" not in plan and sorted(r.q for r in got.collect() if r.t == 39) == [3, 39]


def test_parts_of_patterns_are_compiled_once():
    """Patterns of one shape are decided where their literal stands, without a pattern compiled for each; any pattern finds what re finds."""
    words = [f"word{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    many = multimatch.Finder([([w], rf"\b{w}(?:s|en)?\b") for w in words], True)
    assert many("x wordabcs, WORDABDEN wordabea xwordaaa wordaabs wordhhhſ") == [words.index(w) for w in ("wordaab", "wordabc", "wordabd", "wordhhh")]
    assert len(many.parts) == 1 and not many.compiled
    rng = random.Random(5)
    heads, tails = ["", r"\b", r"\B"], ["", r"\b", "s?", r"(?:s|en)?\b", "|b", r"\w*c", "(?=k)", "{2}", "*", "?", r"(a|b)\1", "(?<=a)b?", "$", "[|]", "(a(b|c))d?", "[)|]|k"]
    held = 0
    for _ in range(1500):
        pattern = rng.choice(heads) + "".join(rng.choice("abcKks") for _ in range(rng.randint(1, 3))) + rng.choice(tails)
        find = multimatch.Finder([(sorted(dictionary.mandatory(pattern) or ()), pattern)], True)
        for _ in range(4):
            text = "".join(rng.choice("abcKks.ıſİKÉé |en") for _ in range(rng.randint(0, 8)))
            held += bool(find(text))
            assert bool(find(text)) == bool(re.search(pattern, text, re.IGNORECASE)), (pattern, text)
    assert held > 300


@pytest.mark.parametrize("k", [3, 300])
def test_a_cell_finds_what_double_precision_finds(k):
    """Rows that single precision can't tell apart, copies, classes, rows of its own, large numbers."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.normal(size=(1, 48))
    v = np.concatenate([base + 2e-6 * rng.normal(size=(700, 48)), np.repeat(base, 600, 0), rng.normal(size=(700, 48))])
    w = np.concatenate([base, v[::40], rng.normal(size=(20, 48))])
    for scale in (0.1, 1e14):
        rows = pa.table({"id": rng.permutation(len(v)), "embedding": list(v * scale), "applies_to": pa.array([[str(i % 3)] if i % 4 else None for i in range(len(v))])})
        asked = pa.table({"query_id": np.arange(len(w)), "wanted": list(w / scale), "classes": pa.array([None if i % 2 else ["1"] for i in range(len(w))])})
        sims = np.round((np.stack(rows["embedding"].to_numpy()).astype(np.float64) @ np.stack(asked["wanted"].to_numpy()).T), search.DIGITS)
        ids, classes = rows["id"].to_numpy(), rows["applies_to"].to_pylist()
        for own in (False, True):
            got = pa.concat_tables(search.best_of(rows, asked, k, own)).to_pydict()
            want = []
            for q in range(len(w)):
                fit = [i for i in range(len(v)) if (q % 2 or not classes[i] or "1" in classes[i]) and not (own and ids[i] == q)]
                want += [(q, int(ids[i])) for i in sorted(fit, key=lambda i: (-sims[i, q], ids[i]))[:k]]
            assert list(zip(got["query_id"], got["id"], strict=True)) == want


def test_few_rows_are_computed_twice():
    rng = np.random.default_rng(6)
    sims = rng.normal(size=(8, 20_000)).astype(np.float32)
    q, row = search.likely(sims, np.full(8, 1e-4), 8)
    assert len(q) < 8 * 16 and all(set(np.argsort(-sims[i])[:8]) <= set(row[q == i]) for i in range(8))
