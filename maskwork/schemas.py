"""Schemas of spans, boxes, text lines and detections."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,label:string,category:string,score:double,source:string>"
SPANS = f"array<{SPAN}>"
#: Sorted by its fields in this order, a candidate's place is its claim: rank, then length, then start.
CANDIDATE = "struct<rank:int,shorter:int,start:int,end:int,label:string,category:string,score:double,source:string>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
POLYGON = f"array<{POINT}>"
LINE = f"struct<line_id:int,text:string,score:double,box:{BOX},bounds:array<struct<t0:double,t1:double>>,orientation:string,polygon:{POLYGON}>"
