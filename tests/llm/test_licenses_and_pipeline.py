import corpus_pipeline
from assay.llm.licenses import TEMPLATES, passages, scan, template_sets

from .helpers import SCHEMA, documents, odd


def plain(text, at_least=0.8):
    import re

    out, units = [], [(0, text or "")]
    lines = (text or "").split("\n")
    if len(lines) > 1:
        units += list(enumerate(lines, 1))
    for at, unit in units:
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in unit)) if x]
        grams = set(w) if len(w) == 1 else {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        for name, _, t in template_sets():
            if grams and 2 * len(grams & set(t)) / (len(grams) + len(t)) >= at_least:
                out.append((at, name))
    return sorted(out)


def test_matches_are_those_of_all_templates(spark):
    texts = [t for _, t in TEMPLATES] + [
        "Some prose.\nreleased under the MIT  license!\nMore prose.", "MIT", "", "license " * 5000,
        TEMPLATES[3][1].replace("Software", "Program", 3), "\n".join(TEMPLATES[3][1].split(". ")),
        "Licensed under the Apache License, Version 2.0. See NOTICE.",
    ]
    got = {}
    for r in scan(odd(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.template))
    want = {i: m for i, t in enumerate(texts, 7) if (m := plain(t))}
    assert {i: sorted(m) for i, m in got.items()} == want and len(want) > len(TEMPLATES)


def runs(text, template, at_least=0.8):
    """Whether any run of words matches, by trying all of them."""
    import re

    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if x]
    pairs = w if " " not in template[0] else [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    best = 0
    for a in range(len(pairs)):
        for b in range(a + 1, len(pairs) + 1):
            g = set(pairs[a:b])
            best = max(best, 2 * len(g & set(template)) / (len(g) + len(template)))
    return best if best >= at_least else None


def test_notices_inside_a_text(spark):
    """Wrapped, in a sentence, with words put in, between prose, beside another."""
    import textwrap

    prose = "".join(f"line {i} of{i} the{i} program and{i} of the case any{i} other{i} use{i} i{i} j{i} k{i} l{i}\n" for i in range(30))
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(TEMPLATES[3][1], 70))
    apache = "\n".join("dnl " + x for x in textwrap.wrap(TEMPLATES[5][1], 70))
    sentence = "The library that we describe was Released under the MIT License. See the file for more on that and all else."
    texts = [
        prose + wrapped + "\n" + prose, prose + apache + "\n" + prose.upper(), sentence, prose + sentence + "\n" + wrapped + "\n" + prose,
        "It is said this work is licensed under the GNU Lesser General Public License, version 3, and many more words follow here.",
        "Permission of the software to deal in the software without any of the notices. " * 5, wrapped + " and " + apache,
    ]
    got = {}
    for r in scan(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.template, round(r.dice, 9)))
    names = {t: g for t, _, g in template_sets()}
    best = lambda i, t: round(runs(texts[i - 1], names[t]), 9)
    end = wrapped.count("\n") + 1
    assert {i: sorted(m) for i, m in got.items()} == {
        1: [(31, "MIT 3", 1.0)], 2: [(31, "Apache-2.0 5", best(2, "Apache-2.0 5"))], 3: [(1, "MIT 0", 1.0)],
        4: [(31, "MIT 0", 1.0), (32, "MIT 3", 1.0)], 5: [(1, "LGPL-3.0 8", 1.0)],
        7: [(1, "MIT 3", 1.0), (end, "Apache-2.0 5", best(7, "Apache-2.0 5"))],
    }
    assert 0.8 < best(2, "Apache-2.0 5") < 1


def test_the_best_run_is_that_of_all_runs(spark):
    import random

    rng, templates = random.Random(3), [("A", "a b c a d e f g"), ("B", "x")]
    texts = [" ".join(rng.choice("abcdefgz") for _ in range(4)) + " " + " ".join(
        x for y in "abcadefg" for x in ([y, "z"] if rng.random() < 0.12 else [] if rng.random() < 0.1 else [y])
    ) + " " + " ".join(rng.choice("abcdzz") for _ in range(12)) for _ in range(60)]
    texts += ["q x q\np1 p2 p3 p4 p5 p6 " + "a b " * 40 + "c a d e f g p7 p8 p9"]
    got = {}
    for r in scan(documents(spark, texts), templates).collect():
        got[r.doc_id, r.template] = max(r.dice, got.get((r.doc_id, r.template), 0))
    sets = template_sets(templates)
    want = {(i, t): b for i, x in enumerate(texts, 1) for t, _, g in sets if (b := runs(x, g))}
    assert got == want and 10 < len(want) < 61 and (61, "B 1") in want


def test_notices_many_times_over(spark):
    """Texts of few distinct words are not read to their end from each start, and each notice is found once."""
    notice = "Released under the MIT License. "
    texts = [notice * 1000, (notice + "See z. ") * 1000, "q0 q1 q2 q3 " + notice * 3 + "q4 q5 q6 q7 q8\n" + "r " * 600 + "\n" + notice + "s t u v w x y"]
    got = {}
    for r in passages(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.template, r.dice))
    assert got.pop(3) == [(1, "MIT 0", 1.0)] * 3 + [(3, "MIT 0", 1.0)]
    assert len(got[2]) == 1000 and set(got[2]) == {(1, "MIT 0", 1.0)}
    assert 1 not in got  # the text as a whole matches: its five bigrams are four of the template and one between notices


def test_no_rows(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert scan(documents(spark, ["MIT"]), templates=[]).count() == 0


def test_every_stage_works_on_what_the_last_one_kept(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").collect()}
    from assay.llm.store import written

    from .test_decontaminate import plain as contaminated
    from .test_near_dups import plain as components

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        if name != "sharding":
            assert docs.columns == columns
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(toxic & set(ids["toxicity"])) <= 0.1 * len(toxic)
    assert len(ids["toxicity"]) > 0.8 * (len(texts) - len(toxic))
    groups = components([(i, texts[i]) for i in ids["toxicity"]])
    assert sorted(ids["near_dedup"]) == sorted(set(groups.values()))
    clean = [i for i in ids["near_dedup"] if not contaminated(texts[i], items)[4]]
    assert sorted(ids["decontamination"]) == sorted(clean)
    assert set(ids["mixing"]) <= set(clean) and max(map(ids["mixing"].count, ids["mixing"])) <= 2
    assert sorted(ids["sharding"]) == sorted(ids["mixing"]) and docs.select("shard").distinct().count() == 24


def test_stages_take_odd_rows(spark):
    folder, docs = "/root/testdata/sf0.001", odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() <= docs.count() + 8
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert {"shard", "slot", *docs.columns} == set(out.columns)
