from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions.stopwords import ENGLISH, read_stop_words, stop_word_frame, stop_words
from tabloom.operators import features as X
from tabloom.operators.word_count import top_words


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr).first()[0]


def test_word_count_splits_like_python(spark):
    texts = ["The  cat sat", " ", "", "CAT\tthe\x1ccat mat.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {}
    for t in texts:
        for w in (t or "").lower().split():
            if w not in ENGLISH:
                want[w] = want.get(w, 0) + 1
    assert {r.word: r.frequency for r in top_words(df, "t").collect()} == want


def test_word_count_ties_and_second_list(spark):
    df = spark.createDataFrame([("b a c yang yang",)], "t string")
    extra = stop_word_frame(spark, ["yang"])
    got = [tuple(r) for r in top_words(df, "t", n=2, stop=[], stop_frame=extra).collect()]
    assert got == [("a", 1), ("b", 1)]


def test_tokens(spark):
    assert one(spark, T.tokenize("t"), "Hi, it's (ok)… naïve_1") == ["Hi", ",", "it", "'", "s", "(", "ok", ")", "…", "naïve_1"]
    assert one(spark, T.tokenize("t"), "") == []


def test_cleaning_order_does_not_depend_on_the_request(spark):
    methods = ["lemmatize_each_word", "remove_stop_words", "remove_punctuation", "standardize_letter_case"]
    cleaned = T.clean_text("t", methods, stop=["the"], lexicon={"cats": "cat"})
    assert one(spark, cleaned, "The CATS, they sat.") == "cat  they sat "


def test_only_marks_and_only_stop_words(spark):
    assert one(spark, T.clean_text("t", ["remove_punctuation"]), "!?") == " "
    assert one(spark, T.clean_text("t", ["remove_stop_words"], stop=stop_words("english")), "The AND of") == ""


def test_unknown_method(spark):
    try:
        T.clean_text("t", ["shout"])
    except ValueError as e:
        assert "shout" in str(e)
    else:
        raise AssertionError


def test_stop_word_files(spark, tmp_path):
    (tmp_path / "english").write_text("the\nof\n")
    (tmp_path / "indonesian").write_text("yang\n\nDan\n")
    got = {tuple(r) for r in read_stop_words(spark, str(tmp_path)).collect()}
    assert got == {("english", "the"), ("english", "of"), ("indonesian", "yang"), ("indonesian", "dan")}


def test_large_lexicon_gives_the_same_as_a_small_one(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["Cats", "x", "cats"]), (2, []), (3, ["mice"])], "id int, tokens array<string>")
    lexicon = spark.createDataFrame([("cats", "cat"), ("mice", "mouse")], "form string, lemma string")
    small = X.lemmatize_with_table(df, "id", "tokens", lexicon, "lemmas").orderBy("id").collect()
    monkeypatch.setattr(X, "INLINE_LEXICON", 1)
    large = X.lemmatize_with_table(df, "id", "tokens", lexicon, "lemmas").orderBy("id").collect()
    assert small == large
    assert [r.lemmas for r in large] == [["cat", "x", "cat"], [], ["mouse"]]


def test_lemmas_are_looked_up_by_hash(spark, monkeypatch):
    monkeypatch.setattr(X, "INLINE_LEXICON", 0)
    rows = [(1, ["A", None, "b", "A", "c"]), (2, None), (3, []), (4, ["z", "C"]), (5, ["b", "a"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").coalesce(1)
    lexicon = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "form string, lemma string")
    done = X.lemmatize_with_table(df, "id", "tokens", lexicon, "lemmas")
    got = {r.id: r.lemmas for r in done.collect()}
    assert got == {1: ["x", None, "y", "x", ""], 2: None, 3: [], 4: ["z", ""], 5: ["y", "x"]}
    assert "element_at" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_not_moved_before_they_are_counted(spark):
    df = spark.createDataFrame([(1, "a B a"), (1, "b c"), (None, "a"), (None, " a d "), (2, None)], "id int, t string")
    counts = X.term_counts(df, "id", "t")
    got = {(r.id, r.term): r.tf for r in counts.collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (None, "a"): 2, (None, "d"): 1}
    moves = [line for line in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert moves and not any("term" in line for line in moves)


def test_lexicon_with_nulls_and_repeats_is_the_same_on_both_sides(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["ran", "ox", "geese", None])], "id int, tokens array<string>")
    given = [("ran", "run"), ("ran", "go"), ("ox", None), (None, "x"), ("geese", "goose")]
    lexicon = spark.createDataFrame(given, "form string, lemma string")
    for limit in (2000, 1):
        monkeypatch.setattr(X, "INLINE_LEXICON", limit)
        got = X.lemmatize_with_table(df, "id", "tokens", lexicon, "lemmas").first().lemmas
        assert got == ["go", "ox", "goose", None]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "")], "id int, t string")
    got = sorted(tuple(r) for r in X.tfidf(df, "id", "t").collect())
    assert [g[:4] for g in got] == [(1, "a", 2, 2), (1, "b", 1, 1), (2, "a", 1, 2), (2, "c", 1, 1)]


def test_stop_words_of_the_caller(spark, tmp_path):
    (tmp_path / "indonesian.txt").write_text("Yang\n\ndan\n", encoding="utf-8")
    assert stop_words("indonesian", str(tmp_path)) == ["yang", "dan"]
    assert stop_words("en", str(tmp_path)) == list(ENGLISH)
    assert "und" in stop_words("de")
    try:
        stop_words("indonesian")
    except ValueError as e:
        assert "folder" in str(e)
    else:
        raise AssertionError
