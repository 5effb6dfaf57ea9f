"""The pipeline's stages against plain versions, stage by stage, and that the rest of the library stands without them."""

import subprocess
import sys

from test_dedup import brute_exact, brute_near

import corpus_pipeline
from sparkloom.llm import bpe, mixing, toxicity
from sparkloom.llm.tables import table, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(written(stage(spark, held[-1], DATA)))
    ids = [[(r["doc_id"], r["text"]) for r in x.select("doc_id", "text").collect()] for x in held[:-1]]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, table(spark, DATA, "labels"))).collect()}
    assert sorted(ids[1]) == sorted(x for x in ids[0] if scores[x[0]] < 0.3)
    assert sorted(x[0] for x in ids[2]) == sorted(i for i, _, _, kept, _ in brute_exact(ids[1]) if kept)
    assert sorted(x[0] for x in ids[3]) == sorted(i for i, (_, root) in brute_near(ids[2], 80).items() if i == root)
    draws = {r["doc_id"]: len(r["draws"]) for r in mixing.mix(held[3]).collect()}
    assert sorted(x[0] for x in ids[4]) == sorted(i for i, n in draws.items() for _ in range(n))
    assert all(x.columns == columns for x in held[1:-1])
    texts = dict(ids[4])
    own = bpe.Codec(*bpe.default_vocabulary())
    last = held[-1].collect()
    assert len(last) == len(ids[4]) and all(own.decode(bpe.np.array(r["ids"])).tobytes() == texts[r["doc_id"]].encode() for r in last)


def test_entry_without_this_folder():
    code = "import sys; sys.modules['sparkloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0]).returncode == 0
