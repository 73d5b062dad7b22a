import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ta", "lo", "mi", "ne", "ru", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus_rows():
    """Texts with exact and near copies, shared passages, repeats within a text, short and empty ones."""
    rng = random.Random(5)
    passage, base = sentence(rng, 60), sentence(rng, 120)
    texts = [sentence(rng, rng.randint(0, 150)) for _ in range(60)]
    texts += [base] * 15
    for _ in range(30):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(" ".join(words))
    texts += [f"{sentence(rng, rng.randint(0, 40))} {passage} {sentence(rng, 30)}" for _ in range(25)]
    texts += [f"{passage}\n{passage} {sentence(rng, 5)}", "", " \n", None, "one two", "One Two", "ab " * 200, "é" * 80, "é" * 90, "x\x00y" * 40]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", None, "s3"]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def corpus_dir(corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    corpus.write.parquet(f"{folder}/documents.parquet")
    items = [(1, "one two"), (2, " ".join((corpus.where("length(text) > 500").orderBy("doc_id").first().text).split()[5:30])), (3, None), (4, "")]
    corpus.sparkSession.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder
