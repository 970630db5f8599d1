from papyrine.llm import quality

COMMON = [("ru", w) for w in ("и", "в", "не", "на", "что", "с", "как", "мне", "по", "для", "же")] + [(None, "x"), ("en", None)]
PROSE = "Для новаго опыта нужно заменить старый приборъ, и мне не ясно, что же мешает работе. Какъ показано ниже, вес шара равен весу лодки. "
LIST = "\n".join(f"- шар медный, {i} шт." for i in range(12))
TABLE = "\n".join(f"| {i} | {i * 7} | [?] | — |" for i in range(12))
JUNK = "тчшф бчъхпу внгст мвпр птрфе ъюдбщ эькды рюэурк ьилуме ысжтуз лшщмб агьиярх ээян ныщвме жчеук ычэбы "


def table(spark):
    texts = [PROSE * (1 + i % 4) for i in range(60)] + [LIST] * 8 + [TABLE] * 8 + [JUNK * 3] * 8 + [None, "", " \n\t "] + [PROSE * 2000]
    return spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, words string, type int")


def test_types(spark):
    got = quality.typed_documents(table(spark), spark.createDataFrame(COMMON, "lang string, word string")).orderBy("doc_id").collect()
    types = [r.type for r in got]
    assert set(types[:60]) == {"prose"} and "prose" not in types[60:84] and set(types[68:76]) == {"table"} and types[84:87] == [None] * 3 and types[87] == "prose"
    found = quality.not_prose(table(spark), spark.createDataFrame(COMMON, "lang string, word string"))
    assert {r[0] for r in found.collect()} == set(range(60, 84))


def test_statistics():
    row = dict(zip(quality.STATISTICS, quality.Measure(quality.common_forms([("ru", "как"), ("ru", "же")])).statistics(["Какъ же так.\n15 домовъ"])[0]))
    assert row["words"] == 4 and row["lines"] == 2 and row["punctuated_lines"] == 0.5 and row["common_words_share"] == 0.5 and row["sentence_ends"] == 1
    assert row["mean_word_length"] == (4 + 2 + 3 + 6) / 4 and row["chars"] == 22
    empty = quality.Measure(frozenset()).statistics([None, "", " "])
    assert [e[:3] for e in empty] == [(0, 0, None), (0, 0, None), (1, 0, None)] and all(e[-1] is None for e in empty)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "lang string, word string")
    assert quality.not_prose(table(spark).limit(0), none).count() == 0
    assert quality.typed_documents(table(spark), none).count() == 88


def test_model_learns_from_agreement():
    prose, lists = sum(1 << r for r in range(3)), sum(1 << r for r in (3, 7))
    model = quality.VoteModel({prose: 900, prose & ~2: 60, lists: 100, 1 << 3: 20})
    assert model.posterior(prose)[0] > 0.99 and model.posterior(lists)[1] > 0.9 and abs(sum(model.posterior(0)) - 1) < 1e-9
