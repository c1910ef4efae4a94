"""Operators for turning the project's evidence texts into training data.

An evidence record is one text file of the project (run record, step log, label-access log, summary,
notice, configuration) as the split table and the file scan describe it:

| column | type | meaning |
|---|---|---|
| `sample_id` | BIGINT | id of the file in its roster |
| `content` | STRING | the file's whole text; null counts as empty |
| `domain` | STRING | domain the file belongs to (source, target, or the folder it comes from) |
| `filepath` | STRING | path relative to the tree's root |

Every operator reads only the columns that it names, under names of its own, so further columns of
any name neither clash nor get lost where rows are passed on.
"""
