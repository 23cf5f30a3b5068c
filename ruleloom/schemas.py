"""Tables of the audit, as schema strings. Every table carries its keys and an ordinal; nothing relies on row order."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
CHECK = "struct<name:string,status:string,expected:string,actual:string,message:string>"
PART = "struct<key:string,value:string>"
CHILD = f"struct<label:string,value:string,selected:boolean,bbox:{BOX}>"
FORMATTING = "struct<font_family:string,font_style:string,font_weight:string,color:string,background_color:string,is_bold:boolean,is_italic:boolean,is_handwritten:boolean,font_size_pt_estimate:double>"

CELLS = "workbook string, sheet string, sheet_ord int, row0 int, col0 int, text string"
RULES = (
    "sheet string, rule_ord int, rule_id string, row_index int, section string, subsection string, item string, if_missing string, if_unknown string, instruction string, "
    "label_printed string, example string, expected_kind string, expected_options array<string>, part_labels array<string>, part_separators array<string>, "
    "max_chars string, shrink_size string, char_size string, bold string, font string, rule_type string"
)
KV_PAIRS = f"doc_id string, page int, kv_ord int, key string, value string, bbox {BOX}, value_bbox {BOX}, confidence double"
LINES = f"doc_id string, page int, line_ord int, text string, bbox {BOX}"
FIELDS = (
    f"doc_id string, field_ord int, page int, kind string, section string, subsection string, key string, value_text string, value_parts array<{PART}>, "
    f"bbox {BOX}, label_bbox {BOX}, confidence double, children array<{CHILD}>"
)
DOCUMENTS = "doc_id string, sheet string, full_text string"
