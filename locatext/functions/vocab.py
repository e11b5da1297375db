"""Word lists and tables that results depend on, stated as they are."""

STOP_WORDS = (
    "a an and are as at be by can do does for from how i in is it of on or project show tell that the this to was were "
    "what when where which who why with would"
).split()

EQUIVALENT_GROUPS = [
    line.split()
    for line in """
accept accepted acceptance approve approved approval
answer answered reply replied response responded
close closed resolve resolved
email e-mail message correspondence
send sent sender from
receive received recipient
spec specification specifications
qty quantity quantities count
dimension dimensions size sizes
require required requirement requirements shall
test tests testing
inspect inspected inspection inspections
material materials
revision revisions rev
drawing drawings dwg
""".strip().splitlines()
]

PHRASE_ALIASES = {
    "request for information": ("request for information", "rfi"),
    "shop drawing": ("shop drawing", "shop drawings", "submittal"),
    "product data": ("product data", "submittal"),
}

RFI_PREFIXES = ("rfi ", "rfi no ", "rfi number ", "request for information ", "request for information no ", "request for information number ")

SUBMITTAL_STATUS = {
    "APPROVED AS SUBMITTED": "APPROVED",
    "FURNISH AS SUBMITTED": "APPROVED",
    "NO EXCEPTIONS TAKEN": "APPROVED",
    "APPROVED WITH COMMENTS": "APPROVED AS NOTED",
    "MAKE CORRECTIONS NOTED": "APPROVED AS NOTED",
    "REVIEWED AS NOTED": "APPROVED AS NOTED",
    "FURNISH AS CORRECTED": "APPROVED AS NOTED",
    "NOT APPROVED": "REJECTED",
    "AMEND AND RESUBMIT": "REVISE AND RESUBMIT",
    "RETURNED FOR CORRECTION": "REVISE AND RESUBMIT",
    "REVISE/RESUBMIT": "REVISE AND RESUBMIT",
    "SUBMITTED": "PENDING",
    "FOR REVIEW": "PENDING",
    "UNDER REVIEW": "PENDING",
}

#: Limits of retrieval, packing and batching.
LIMITS = {
    "query_terms": 10, "search_terms": 24, "candidates": 160, "family_candidates": 12, "identifier_candidates": 12,
    "results": 8, "fragment_chars": 1600, "fragment_bytes": 2200, "window_chars": 2600, "context_chars": 18000,
    "anchors": 8, "anchor_rows": 3, "structural_rows": 24, "sheet_pages": 8, "page_rows": 40, "inventory": 50,
    "conflict_sources": 32, "pages": 4, "page_bytes": 48000, "page_candidates": 256, "bundle_bytes": 42000,
    "block_bytes": 12000, "batch_items": 4, "batch_bytes": 8800,
}

DASHES = "‐‑‒–—−"
