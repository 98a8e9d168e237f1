"""Raw JSON responses: drift of the schema, what can't be read, cones."""

import json

from lyraflux.sources import responses, survey

EPOCH = {"hjd": 2460000.5, "mag": 15.0, "magerr": 0.1, "catflags": 0, "programid": 1}


def raw(spark, *bodies):
    return spark.createDataFrame([(b if b is None or isinstance(b, str) else json.dumps(b),) for b in bodies], "body string")


def success(*docs):
    return {"status": "success", "message": "", "data": list(docs)}


def test_documents_whose_schema_drifts(spark):
    docs = [
        {"_id": 1, "filter": 1, "ra": 1.5, "dec": -2.0, "data": [EPOCH]},
        {"_id": "2", "filter": "2", "ra": "3.25", "dec": None, "data": [{**EPOCH, "mag": "16.5", "new": 1}, None, 5], "quality": {"a": [1]}, "x": None},
        {"_id": 3, "ra": "east", "data": []},
    ]
    kept, problems = responses.documents(raw(spark, success(*docs)))
    assert problems.isEmpty()
    rows = {r["_id"]: r for r in kept.collect()}
    assert (rows[1]["ra"], rows[1]["dec"], rows[1]["filter"], rows[1]["rest"]) == (1.5, -2.0, 1, {})
    assert (rows[2]["ra"], rows[2]["dec"], rows[2]["filter"]) == (3.25, None, 2)
    assert [p["mag"] for p in rows[2]["data"]] == [16.5] and set(rows[2]["rest"]) == {"quality", "x"}
    assert rows[2]["rest"]["quality"].toJson() == '{"a":[1]}'
    assert rows[3]["ra"] is None and rows[3]["data"] == []
    assert sorted(map(tuple, responses.new_fields(kept).collect())) == [("quality", 1), ("x", 1)]


def test_problems_are_reported_and_good_documents_stay(spark):
    whole = {"_id": 9, "filter": 1, "data": [EPOCH]}
    bodies = (None, "", '{"status": "success", "da', "[1, 2]", {"status": "error", "message": "no such id"}, {"message": 5}, success("text", 7, None, {"filter": 1}, {"_id": 1.5, "data": []}, {"_id": 2, "data": {}}, whole), success(), {"status": "success", "data": None})
    kept, problems = responses.documents(raw(spark, *bodies))
    assert [r["_id"] for r in kept.collect()] == [9]
    found = sorted((r["kind"], r["message"] or "") for r in problems.collect())
    kinds = [k for k, _ in found]
    assert kinds.count("unparsable") == 3 and ("failed", "no such id") in found and kinds.count("failed") == 3
    malformed = sorted(r["text"] for r in problems.where("kind = 'malformed'").collect() if r["text"] is not None)
    assert '"text"' in malformed and '{"filter":1}' in malformed and kinds.count("malformed") in (5, 6)


def test_light_curves_of_raw_responses(spark):
    kept, _ = responses.documents(raw(spark, success({"_id": 4, "filter": 2, "ra": 1.0, "dec": 2.0, "data": [EPOCH, {**EPOCH, "hjd": 2460001.5, "catflags": 3}]})))
    rows = survey.light_curves(kept).collect()
    assert [(r["source_id"], r["band"], r["t"], r["mag"]) for r in rows] == [("4", "r", 2460000.5, 15.0)]


def test_cones(spark):
    doc = {"_id": 1, "filter": 1, "data": [EPOCH]}
    body = {"status": "success", "data": {"one": {"center": [doc], "other": [{**doc, "_id": 2}]}, "two": {"center": [{**doc, "_id": 3}, 4]}, "three": {}}}
    kept, problems = responses.cone_documents(raw(spark, body, {"status": "success", "data": {}}))
    assert sorted(r["_id"] for r in kept.collect()) == [1, 3] and [r["kind"] for r in problems.collect()] == ["malformed"]
    assert [r["_id"] for r in responses.cone_documents(raw(spark, body), target="other")[0].collect()] == [2]


def test_no_responses(spark):
    kept, problems = responses.documents(raw(spark))
    assert kept.isEmpty() and problems.isEmpty()
