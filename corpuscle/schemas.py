"""Tables of the engine as Spark schemas. Types are enforced on read; keys are named in KEYS."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "meta": "key STRING, value STRING",
    "channels": "channel_id STRING, handle STRING, title STRING, description STRING, avatar_url STRING, country STRING, subscriber_count BIGINT, video_count BIGINT, source STRING, etag STRING, fetched_at TIMESTAMP, updated_at TIMESTAMP",
    "videos": "video_id STRING, channel_id STRING, title STRING, description STRING, tags ARRAY<STRING>, category_id STRING, duration_sec BIGINT, published_at TIMESTAMP, view_count BIGINT, like_count BIGINT, comment_count BIGINT, thumb_url STRING, embedding ARRAY<FLOAT>, source STRING, fetched_at TIMESTAMP, updated_at TIMESTAMP, recording_date TIMESTAMP, recording_location_name STRING, recording_lat DOUBLE, recording_lng DOUBLE, topic_categories ARRAY<STRING>, privacy_status STRING",
    "competitors": "channel_id STRING, label STRING, added_at TIMESTAMP",
    "keywords": "keyword STRING, niche STRING, created_at TIMESTAMP",
    "keyword_rankings": "keyword STRING, checked_at TIMESTAMP, video_id STRING, position BIGINT, topics ARRAY<STRING>",
    "scores": "video_id STRING, seo_score DOUBLE, geo_score DOUBLE, total_score DOUBLE, components MAP<STRING,DOUBLE>, computed_at TIMESTAMP",
    "ideas": "idea_id BIGINT, title_suggestion STRING, rationale MAP<STRING,DOUBLE>, score DOUBLE, status STRING, source_video STRING, created_at TIMESTAMP",
    "edges": "from_channel STRING, to_channel STRING, weight DOUBLE, source STRING",
    "alerts": "alert_id BIGINT, kind STRING, channel_id STRING, message STRING, severity STRING, created_at TIMESTAMP, read_at TIMESTAMP",
    "ingest_log": "log_id BIGINT, batch_id STRING, item STRING, status STRING, detail STRING, at TIMESTAMP",
    "tags": "tag_id BIGINT, name STRING",
    "video_tags": "video_id STRING, tag_id BIGINT, position BIGINT, source STRING",
    "competitor_tags": "channel_id STRING, tag_name STRING, video_count BIGINT, avg_views DOUBLE, rank BIGINT",
    "transcripts": "video_id STRING, lang STRING, source STRING, text STRING, word_count BIGINT, fetched_at TIMESTAMP",
    "comments": "comment_id STRING, video_id STRING, author STRING, text STRING, like_count BIGINT, published_at TIMESTAMP, fetched_at TIMESTAMP",
    "video_heatmap": "video_id STRING, points ARRAY<STRUCT<start_time: DOUBLE, value: DOUBLE>>, fetched_at TIMESTAMP",
    "channel_snapshots": "channel_id STRING, at TIMESTAMP, subscriber_count BIGINT, video_count BIGINT, total_views BIGINT",
    "keyword_research": "research_id BIGINT, keyword STRING, at TIMESTAMP, volume_label STRING, serp_total BIGINT, serp_mean_views DOUBLE, ranking_channels BIGINT, competition_score DOUBLE, opportunity_score DOUBLE, actively_published BOOLEAN, suggested_tags ARRAY<STRUCT<tag: STRING, usage: BIGINT>>, related_keywords ARRAY<STRING>",
    "kg_entities": "entity_id STRING, entity_type STRING, canonical_name STRING, display_name STRING, properties MAP<STRING,STRING>, embedding ARRAY<FLOAT>, centrality DOUBLE, community_id BIGINT, source STRING, source_ref STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "kg_relations": "from_id STRING, to_id STRING, relation_type STRING, weight DOUBLE, source STRING, created_at TIMESTAMP",
    "kg_communities": "community_id BIGINT, community_type STRING, summary STRING, member_count BIGINT, mean_views DOUBLE, mean_seo_score DOUBLE, top_entities ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP",
    "greedy_seeds": "seed_id BIGINT, seed STRING, source STRING, added_at TIMESTAMP, active BOOLEAN",
    "greedy_research_history": "research_id BIGINT, topic STRING, researched_at TIMESTAMP, video_ids_json ARRAY<STRING>, video_count BIGINT, mean_views DOUBLE, source STRING, duration_ms BIGINT",
    "greedy_topic_log": "log_id BIGINT, topic STRING, status STRING, reason STRING, attempted_at TIMESTAMP",
}

KEYS = {
    "meta": ["key"], "channels": ["channel_id"], "videos": ["video_id"], "competitors": ["channel_id"], "keywords": ["keyword"], "keyword_rankings": ["keyword", "checked_at"], "scores": ["video_id"], "ideas": ["idea_id"],
    "edges": ["from_channel", "to_channel"], "alerts": ["alert_id"], "ingest_log": ["log_id"], "tags": ["tag_id"], "video_tags": ["video_id", "tag_id"], "competitor_tags": ["channel_id", "tag_name"], "transcripts": ["video_id"],
    "comments": ["comment_id"], "video_heatmap": ["video_id"], "channel_snapshots": ["channel_id", "at"], "keyword_research": ["research_id"], "kg_entities": ["entity_id"], "kg_relations": ["from_id", "to_id", "relation_type"],
    "kg_communities": ["community_id"], "greedy_seeds": ["seed_id"], "greedy_research_history": ["research_id"], "greedy_topic_log": ["log_id"],
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
