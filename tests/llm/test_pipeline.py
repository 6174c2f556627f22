"""The pipeline, stage by stage, against plain Python on the rows that the stage before it kept."""

from collections import Counter, defaultdict

import corpus_pipeline
from corpusloom.llm.columns import durable
from corpusloom.llm.importance import kth_largest, sampler
from corpusloom.llm.queries import table
from tests.llm import brute
from tests.llm.test_native import targets

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def plain_lines(docs: list) -> list[tuple]:
    pages, seen = Counter(r["source"] for r in docs), Counter()
    for r in docs:
        seen.update((r["source"], x) for x in {x.strip(SPACES) for x in r["text"].split("\n")} - {""})
    bad = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    out = []
    for r in docs:
        text = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(SPACES)) not in bad)
        out.append((r["doc_id"], text, len(text)))
    return sorted(out)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    rows = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows.append(durable(stage(spark, rows[-1], FOLDER)))
        assert i == len(names) - 1 or rows[-1].columns == columns
    held = [sorted(x.collect(), key=lambda r: r["doc_id"]) for x in rows]

    found, keyed = sampler(docs, table(spark, FOLDER, "labels"))
    k = keyed.where("_weight >= -50").count()
    best = sorted(keyed.collect(), key=lambda r: -r["_sort"])[:k]
    assert [r["doc_id"] for r in held[1]] == sorted(r["_id"] for r in best) and found.cut == kth_largest(keyed, "_sort", k)
    assert 0.5 * len(held[0]) < len(held[1]) < len(held[0])

    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in held[2]] == plain_lines(held[1])

    component = brute.components([(r["doc_id"], r["text"]) for r in held[2]])
    assert [r["doc_id"] for r in held[3]] == sorted(d for d, _, least in component if d == least)

    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    hit = {r[0] for r in brute.benchmark_hits([(r["doc_id"], r["text"]) for r in held[3]], items) if r[5]}
    assert [r["doc_id"] for r in held[4]] == [r["doc_id"] for r in held[3] if r["doc_id"] not in hit]

    copies = Counter(r["doc_id"] for r in held[5])
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"])) for r in held[4]}
    per, got, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in held[4]:
        per[r["source"]] += size[r["doc_id"]]
        got[r["source"]] += size[r["doc_id"]] * copies[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    want = targets(per)
    assert max(copies.values()) <= 3 and all(abs(got[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in per)


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[-2:] == ["copy", "shard"] and out.count() > 0
