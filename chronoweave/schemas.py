"""Row layouts of the data model, as DDL; scans use them and never infer."""

DOCUMENT = "doc_id string, title string, content string, source_idx string"
CHUNK = "chunk_id string, content string, doc_id string, doc_title string, source_idx string, chunk_index int, start_char int, end_char int, strategy string, token_count int, metadata map<string,string>"
ENTITY = "struct<name:string,canonical_name:string,description:string>"
EVENT = f"event_id string, original_sentence string, event_description string, entities array<{ENTITY}>, time_type string, time_start string, time_end string, time_expression string, chunk_id string, doc_id string, doc_title string, confidence double, metadata map<string,string>"
CLUSTER = f"cluster_id string, canonical_name string, merged_description string, member_count int, member_entities array<{ENTITY}>, source_event_ids array<string>"
TIMELINE = "timeline_id string, entity_canonical_name string, timeline_name string, description string, event_ids array<string>, time_span_start string, time_span_end string"
NODE = "id string, node_type string, cluster_id string, canonical_name string, description string, source_event_ids string, aliases string, event_id string, event_description string, time_type string, time_start string, time_end string, time_expression string, original_sentence string, chunk_id string, doc_id string, doc_title string, entity_names string, timeline_id string, timeline_name string, entity_canonical_name string, time_span_start string, time_span_end string, event_ids string"
EDGE = "source string, target string, edge_type string, role string, order int"
QUESTION = "original_question string, question_stem string, time_constraint struct<constraint_type:string,original_expression:string,normalized_time:string,description:string>, event_type string, answer_type string"
RELATION = "relation_id string, relation_type string, subject string, object_entity string, time_start string, time_end string, confidence double, source_event_ids array<string>, source_description string"
SUBTASK = "struct<task_id:string,question:string,tool:string,tool_params:map<string,string>,depends_on:array<string>,reasoning:string>"
PLAN = f"original_query string, query_analysis struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ('original_question string', 'question_stem string', 'time_constraint struct<constraint_type:string,original_expression:string,normalized_time:string,description:string>', 'event_type string', 'answer_type string'))}>, subtasks array<{SUBTASK}>, total_tasks int, timestamp string"
EMBEDDING = "node_id string, embedding array<float>"

# What a language model answers with.
ANSWERS = {
    "events": "struct<events:array<struct<original_sentence:string,event_description:string,entities:array<struct<name:string,canonical_name:string,description:string>>,time_type:string,time_start:string,time_end:string,time_expression:string>>>",
    "time_fix": "struct<time_start:string,time_end:string,correction_note:string>",
    "timelines": "struct<timelines:array<struct<timeline_id:string,timeline_name:string,description:string,event_ids:array<string>>>,standalone_events:array<struct<event_id:string,reason:string>>>",
    "parse": "struct<original_question:string,question_stem:string,time_constraint:struct<constraint_type:string,original_expression:string,normalized_time:string,description:string>,event_type:string,answer_type:string>",
    "queries": "struct<entity_query:string,timeline_query:string,event_queries:array<string>>",
    "relations": "struct<relations:array<struct<relation_type:string,subject:string,object_entity:string,time_start:string,time_end:string,confidence:double>>>",
    "filter": "struct<relevant_indices:array<int>,reasoning:string>",
    "plan": f"struct<subtasks:array<{SUBTASK}>>",
    "answer": "struct<answer:string>",
}
