"""Schemas of the data model."""

MESSAGES = (
    "seq bigint, sender string, text string, ts timestamp, channel string, thread_id string, "
    "participant_only boolean, source string"
)
CHANNELS = "seq bigint, name string, channel_type string"
PEOPLE = "seq bigint, name string, aliases array<string>"
NODES = (
    "id string, type string, name string, aliases array<string>, channel_type string, entity_type string, "
    "global_frequency bigint, channel string, start_ts timestamp, end_ts timestamp, participant_count bigint, "
    "message_count bigint, participants array<string>, thread_id string, raw_text string, pagerank double, node_seq bigint"
)
EDGES = "edge_seq bigint, src string, dst string, type string, weight double, text string, by string, detail string"
ANNOTATIONS = (
    "node_id string, type string, text string, by string, target_entity string, summary string, "
    "decisions array<string>, topics array<string>, sentiment string, at timestamp"
)
VISITS = "node_id string, at timestamp"
ENRICHMENT = (
    "summary string, decisions array<string>, topics array<string>, sentiment string, "
    "relationships array<struct<`from`: string, `to`: string, edge: string, detail: string>>"
)


def columns(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).names
