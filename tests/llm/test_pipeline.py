import random

import numpy as np
import public_tokenizers
from helpers import AWKWARD, documents, prose
from test_decontaminate import greedy
from test_dedup import brute_classes
from test_rules import WORD, counts
from tokenizers import Tokenizer

import corpus_pipeline
from linkloom.llm import decontaminate, quality


def good(text):
    n, chars, symbols, dup, repeat = counts(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = sum(w in quality.STOP_WORDS for w in WORD.findall(text))
    return 2 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.02 and dup / len(lines) <= 0.4


def remains(docs):
    first, out = {}, []
    for d, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], d) < d:
                gone[k : k + 50] = True
        out.append((d, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def leaks(text, items):
    words = decontaminate.WORD.findall(text.lower())
    for item in items:
        own = decontaminate.WORD.findall(item.lower())
        if greedy(words, own, 5) >= 0.5 * len(own):
            return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    items = [prose(25, 4000 + k) for k in range(6)]
    docs = [x for x in AWKWARD if x[0] is not None]
    common = "été " + prose(30, 5000)
    for k in range(40):
        words = prose(90, 6000 + k % 25).split()
        if k >= 25:
            words[r.randrange(90)] = "changed"
        text = " ".join(words)
        if k % 4 == 0:
            text += "\n" + common + "ñ tail " + str(k)
        if k % 9 == 0:
            text += "\n" + items[k % 6]
        if k % 10 == 7:
            text = text.upper()
        docs.append((100 + k, text))
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(d, t) for d, t in docs if good(t or "")]
    heads = {c for _, c, _ in brute_classes(kept)}
    kept = remains([(d, t) for d, t in kept if str(d) in heads])
    kept = [(d, t) for d, t in kept if not leaks(t, items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in kept}
    got = {}
    for x in sorted(rows, key=lambda x: x.start):
        got.setdefault(x.doc_id, []).extend(np.frombuffer(x.ids, "<u4").tolist())
    assert got == want and 10 < len(want) < len(docs)


def test_stages_bear_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
