"""The tables of the model. A cell is one salary of a schedule (district, school year, period), lane and step."""

from __future__ import annotations

SCHEDULE = ["district_id", "school_year", "period"]
LANE = ["education", "credits"]
CELL_KEY = [*SCHEDULE, *LANE, "step"]

CELLS = "district_id string, district_name string, school_year string, period string, education string, credits int, step int, salary decimal(12,2), is_calculated boolean, is_calculated_from struct<education:string,credits:int,step:int>, source_step int, source_edu_credit string"
DISTRICTS = "district_id string, name string, main_address string, district_url string, contract_pdf string, towns array<string>, district_type string, created_at timestamp, updated_at timestamp"
RECORDS = "district_id string, district_name string, school_year string, period string, education string, credits int, step int, salary double"
BACKUPS = f"district_id string, district_name string, applied_at string, records_count int, records array<struct<{', '.join(x.replace(' ', ':', 1) for x in RECORDS.split(', '))}>>"
SOURCE_DISTRICT = "struct<district:string,members:array<string>,address:string,district_url:string,type:string>"
JOBS = "job_id string, seq bigint, status string, ts timestamp, processed int, succeeded int, failed int, ttl bigint"
OCR_BLOCKS = "Id string, BlockType string, RowIndex int, ColumnIndex int, Text string, Relationships array<struct<Type:string,Ids:array<string>>>"

# The order of education levels, the two types that are compared, and the order of types in lists.
EDUCATION_ORDER = {"B": 1, "M": 2, "D": 3}
COMPARED_TYPES = ("municipal", "regional_academic")
TYPE_ORDER = {"municipal": 1, "regional_academic": 2, "regional_vocational": 3, "county_agricultural": 4, "charter": 5, "other": 6}
