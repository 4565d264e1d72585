from textlens.sources.tables import read_table, read_labelled_csv, read_user_csv, text_column
from textlens.sources.lexicon import Lexicon, lexicon_frame
from textlens.sources.sinks import write_csv, append_log, truncate_log, read_log

__all__ = ["read_table", "read_labelled_csv", "read_user_csv", "text_column", "Lexicon", "lexicon_frame",
           "write_csv", "append_log", "truncate_log", "read_log"]
