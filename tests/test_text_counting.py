"""The categorizer's vocabulary."""

from pyspark.ml import PipelineModel

from tideledger.operators import text


def test_vocabulary_is_counted_over_all_rows_and_ties_are_cut_by_text(spark):
    rows = [("aa bb aa", "x"), ("bb cc", "y"), ("zz yy", "y"), ("", "x"), ("a", "y")]
    shredded = PipelineModel(text._counting(4).getStages()[:3]).transform(spark.createDataFrame(rows, "transaction_description string, category string"))
    assert text.frequent_grams(shredded, 4) == ["aa", "bb", "aa bb", "bb aa"]
    assert text.frequent_grams(shredded, 100) == ["aa", "bb", "aa bb", "bb aa", "bb cc", "cc", "yy", "zz", "zz yy"]


def test_every_row_is_categorized_by_a_model_of_few_words(spark):
    rows = [(f"{'rent house' if n % 2 else 'milk bread'} no{n}", "home" if n % 2 else "food") for n in range(60)]
    fitted = text.train_categorizer(spark.createDataFrame(rows, "transaction_description string, category string"), requested={"max_features": 6})
    assert fitted.model.stages[3].vocabulary == ["bread", "house", "milk", "milk bread", "rent", "rent house"]
    assert fitted.metrics == {"accuracy": 1.0, "f1_macro": 1.0, "test_rows": 12}
