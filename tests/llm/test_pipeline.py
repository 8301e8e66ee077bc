import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folioseek.llm.bpe import RankedVocabulary
from folioseek.llm.queries import QUERIES


def test_stages_and_names():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "private_data", "tokens"]
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))


def test_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    syllables = "ba de fi go ku la me ni po ra se ti vo wi zan der mar ten".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    insults = ["dumkopf", "wretch", "blighter", "varlet"]
    benchmark = [(i, prose(30)) for i in range(5)]
    docs, labels, clean = [], [], set()

    def put(text, toxic=0):
        docs.append((len(docs), text, "en", "s", len(text)))
        labels.append((docs[-1][0], 1, toxic))
        return docs[-1][0]

    for i in range(400):
        text = prose(rng.randint(30, 80))
        if i % 5 == 0:
            words = text.split()
            for w in rng.sample(insults, 3):
                words.insert(rng.randrange(len(words)), w)
            put(" ".join(words), 1)
        else:
            clean.add(put(text))
    base = prose(200)
    clean.add(put(base))
    put(base), put(base + " end")
    put(f"{prose(5)} {benchmark[0][1]} {prose(5)}")
    private = put(f"{prose(20)} jane.doe@example.com {prose(20)}")
    clean.add(private)
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, None, "en", "s", 0)]
    tables = {
        "documents": (docs + odd, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (benchmark, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == clean | {None, 9001, 9002}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    one = min(clean)
    assert out[one]["n_tokens"] == len(library.encode(docs[one][1], add_special_tokens=False).ids)
    assert out[9002]["n_tokens"] == 0
    changed = RankedVocabulary(public_tokenizers.path("word_bpe_49k.json")).encode(docs[private][1])
    assert out[private]["ids_sha256"] != __import__("hashlib").sha256(" ".join(map(str, changed)).encode()).hexdigest()
