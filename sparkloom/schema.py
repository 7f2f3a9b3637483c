"""Schemas of the code graph: nodes (files, chunks, symbols), edges, raw references and the commit log."""

FILES = "path string, language string, content string, hash string, last_modified long"
CHUNKS = "chunk_id string, path string, content string, start_line int, end_line int, node_type string, scopes array<string>"
SYMBOLS = "symbol_id string, name string, kind string, path string, start_line int, end_line int, parent_scope string"
EDGES = "src string, dst string, relation string"
REFS = "path string, ref_kind string, name string, alias string, context string, line int"
COMMITS = "commit_id string, timestamp long, note string"
RELATIONS = ("defines", "contains", "calls", "imports")
