from dataclasses import replace

from tether import Config, Resolver, ResolverModel
from tether.streaming.resolve import resolve_stream

ROWS = [
    (1, "Crystal Clean LLC", "123 Main St, Rockford IL"),
    (2, "Crystal Clean", "123 Main Street, Rockford, IL"),
    (3, "Crystal-Clean Inc.", "123 Main St, Rockford"),
    (4, "Midwest Waste Services", "456 Oak Ave, Hoffman Estates"),
    (5, "Midwest Waste", "456 Oak Avenue, Hoffman Estates IL"),
]
SCHEMA = "rec_id long, company_name string, address string"


def test_fit_save_load_transform(spark, tmp_path):
    model = Resolver().fit(spark.createDataFrame(ROWS, SCHEMA))
    got = {r["rec_id"]: r for r in model.resolved.collect()}
    assert len(got) == 5 and got[1]["canonical_name"] == got[2]["canonical_name"] == "Crystal Clean"
    assert got[1]["final_cluster"] == got[2]["final_cluster"] != -1
    assert model.review().columns == ["original_name", "original_address", "canonical_name", "canonical_address"]
    assert model.report().where("metric = 'total_records'").first()["value"] == 5
    path = f"file://{tmp_path}/model"
    model.save(path)
    again = ResolverModel.load(spark, path)
    assert again.resolver.config == model.resolver.config == Config()
    new = spark.createDataFrame([(9, "CRYSTAL CLEAN, INC", "123 Main Street Rockford IL"), (10, "Other", "1 Elm Rd, Peoria IL")], SCHEMA)
    told = {r["rec_id"]: r for r in again.transform(new).collect()}
    assert told[9]["final_cluster"] == got[1]["final_cluster"] and not told[9]["is_new_entity"] and told[10]["is_new_entity"]

    # the same record in a batch of others that share its words
    more = spark.createDataFrame([(9, "CRYSTAL CLEAN, INC", "123 Main Street Rockford IL"), (11, "Crystal Clean Inc Two", "9 Oak St, Rockford IL"), (12, "Inc Crystal", "123 Main St, Peoria IL")], SCHEMA)
    beside = next(r for r in again.transform(more).collect() if r["rec_id"] == 9)
    assert beside == told[9]

    inbox, out = tmp_path / "inbox", tmp_path / "out"
    new.write.parquet(f"file://{inbox}")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{inbox}")
    resolve_stream(again, stream, f"file://{out}", f"file://{tmp_path}/progress").awaitTermination(120)
    assert spark.read.parquet(f"file://{out}").count() == 2


def test_vector_model_places_new_records_by_vectors(spark, tmp_path):
    kinds = [("Crystal Clean", "123 Main St, Rockford IL"), ("Midwest Waste Services", "456 Oak Ave, Peoria IL"), ("Golden Harvest Bakery", "77 Elm Rd, Madison WI")]
    rows = [(10 * k + i, name + end, address) for k, (name, address) in enumerate(kinds) for i, end in enumerate(("", " LLC", " Inc.", " Co"))]
    base = Config()
    cfg = replace(base, modeling=replace(base.modeling, tfidf_params={**base.modeling.tfidf_params, "min_df": 1}))
    model = Resolver(cfg, method="vector").fit(spark.createDataFrame(rows, SCHEMA))
    of = {r["rec_id"]: r["final_cluster"] for r in model.resolved.collect()}
    assert all(of[10 * k] == of[10 * k + i] != -1 for k in range(3) for i in range(4)) and len({of[0], of[10], of[20]}) == 3
    path = f"file://{tmp_path}/model"
    model.save(path)
    again = ResolverModel.load(spark, path)
    # 0 is a known id too; 51 is near in its vector but in another state; 52 has nothing of the others
    new = [(0, "MIDWEST WASTE SERVICES, LLC", "456 Oak Avenue, Peoria IL"), (51, "Crystal Clean", "123 Main St, Rockford WI"), (52, "Zebra Quilt", "9 Fig Ln, Ames IA")]
    told = {r["rec_id"]: r for r in again.transform(spark.createDataFrame(new, SCHEMA)).collect()}
    assert told[0]["final_cluster"] == of[10] and not told[0]["is_new_entity"] and told[0]["cluster_probability"] > 0
    assert told[51]["is_new_entity"] and told[52]["is_new_entity"] and len(told) == 3
    alone = again.transform(spark.createDataFrame(new[:1], SCHEMA)).collect()
    assert alone == [told[0]]
    assert again.transform(spark.createDataFrame([], SCHEMA)).count() == 0
