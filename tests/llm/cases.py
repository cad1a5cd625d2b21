"""Small tables with the awkward rows: nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""

import random

WORDS = "amber basin cedar delta ember fjord grove haven islet jetty knoll ledge marsh north ocean plain quarry ridge shore trail upland vale woods yield zephyr".split()

#: Names that operators use inside.
EXTRA = "hash row _hash _gone gone gone_hash key node fp h s words template leaf blocks by owner doc pos t x y part length rank own_rank base first seq at per n of dropped kept place shard ids n_tokens score predicted bands least root item_id containment width size_class met set a b other leaders a.b value".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))


def awkward(spark):
    rng = random.Random(11)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), prose(rng, 90), "", None, "one", "Two words", "a\n\nb\n c  d\t", prose(rng, 6000), "été naïve — 日本語 text 🙂", "x" * 30000]
    rows = [(i, t, "en", "src", 0, *EXTRA) for i, t in enumerate(texts)]
    rows.append((None, "no id here at all", None, None, None, *[None] * len(EXTRA)))
    rows.append(rows[3])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))


def empty(spark):
    return awkward(spark).limit(0)


def benchmark(spark, docs):
    text = docs.where("doc_id = 9").first().text.split()
    return spark.createDataFrame([(0, " ".join(text[1000:1040])), (1, prose(random.Random(5), 40)), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
