"""Each stage of the corpus pipeline against a plain version, on what the stage before kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from conftest import SF
from llm import brute
from rasterqa.llm import secrets, toxicity
from rasterqa.llm.common import crc_fold, saved
from rasterqa.llm.queries import tokenizer_path


def masked(rows):
    """Texts with live-looking secrets masked: plain spans, and owners counted by hand."""
    value = re.compile(secrets.VALUE.replace("*+", "*").replace("++", "+"))
    spans, owners = {}, defaultdict(set)
    for r in rows:
        found = []
        for kind, a, e in brute.secrets(r.text):
            raw = r.text[a:e]
            found.append((a, e, value.match(raw)[1] if kind == "assign" else raw))
            owners[found[-1][2]].add(r.source)
        spans[r.doc_id] = found
    out = {}
    for r in rows:
        text, at = "", 0
        for a, e, s in sorted(x[:3] for x in spans[r.doc_id] if len(owners[x[2]]) < secrets.EXAMPLE_OWNERS):
            if a >= at:
                text += r.text[at:a] + secrets.MASK
            at = max(at, e)
        out[r.doc_id] = text + r.text[at:]
    return out


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        kept.append((name, docs.collect(), out.collect()))
        docs = out
    assert [k[0] for k in kept] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]

    _, before, after = kept[0]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(given, spark.read.parquet(f"{SF}/labels.parquet").filter(crc_fold(5) != 0))
    clean = {r.doc_id for r in toxicity.score(given, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in after} == clean

    _, before, after = kept[1]
    classes = brute.near_classes([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, low) in classes.items() if i == low)

    _, before, after = kept[2]
    want = masked(before)
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after if want[r.doc_id] != {b.doc_id: b.text for b in before}[r.doc_id])

    _, before, after = kept[3]
    times, size = Counter(r.doc_id for r in after), {r.doc_id: len(brute.words(r.text)) for r in before}
    assert max(times.values()) <= 3 and set(times) <= set(size)
    sources = defaultdict(int)
    for r in before:
        sources[r.source] += size[r.doc_id]
    for s, target in brute.targets(sources).items():
        ids = [r.doc_id for r in before if r.source == s]
        assert abs(sum(size[i] * times[i] for i in ids) - target) <= max(size[i] for i in ids) + 1

    _, before, after = kept[4]
    t = Tokenizer.from_file(tokenizer_path())
    assert brute.check_packing(after, [(r.doc_id, r.text) for r in before], lambda x: t.encode(x, add_special_tokens=False).ids) < 0.05


def test_run_gives_the_packed_pieces(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
