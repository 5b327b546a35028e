from conftest import SF_SMALL

from estimark import schemas as SC
from estimark.operators import votes as V
from estimark.sources import bindings as B


def test_bindings_conform_to_the_model(spark):
    pairs = {
        "rooms": B.b_rooms(spark, SF_SMALL), "persons": B.b_persons(spark, SF_SMALL),
        "connections": B.b_connections(spark, SF_SMALL), "tasks": B.b_tasks(spark, SF_SMALL),
        "votes": V.latest_vote(B.b_vote_log(spark, SF_SMALL)), "dictionary": B.b_dictionary(spark),
        "room_requests": B.b_room_request_xml(spark, SF_SMALL), "messages": B.b_messages(spark, SF_SMALL),
        "task_results": V.task_median(V.latest_vote(B.b_vote_log(spark, SF_SMALL)), B.b_dictionary(spark)),
    }
    for name, df in pairs.items():
        assert SC.conforms(df, name) == [], name


def test_read_model_table(spark, tmp_path):
    df = B.b_dictionary(spark)
    p = str(tmp_path / "dict")
    df.write.parquet(p)
    back = SC.read_model_table(spark, p, "dictionary")
    assert back.schema.simpleString() == SC.MODEL["dictionary"].simpleString()
    assert back.count() == 3
