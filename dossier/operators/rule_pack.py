"""The built-in risk rules as a table of the form that ``evidence.hits_by_document`` takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTABLE = ("medium", "high")
#: Rules over findings of a check: rule, check type, findings, severities (None: any), weight.
FINDING_RULES = (
    ("metadata.pdf_unreadable", "metadata_forensics", ("pdf_unreadable",), None, 20),
    ("metadata.stripped", "metadata_forensics", ("metadata_entirely_stripped",), None, 12),
    ("metadata.editing_software_detected", "metadata_forensics", ("editing_software_detected",), None, 30),
    ("metadata.pdf_editor_producer", "metadata_forensics", ("pdf_editor_detected",), None, 10),
    ("metadata.creation_date_mismatch", "metadata_forensics", ("info_xmp_creation_date_mismatch",), None, 18),
    ("metadata.mod_date_mismatch", "metadata_forensics", ("info_xmp_mod_date_mismatch",), None, 18),
    ("metadata.producer_mismatch", "metadata_forensics", ("info_xmp_producer_mismatch",), None, 10),
    ("metadata.modified_after_creation", "metadata_forensics", ("mod_date_after_creation_date",), None, 15),
    ("metadata.incremental_update_single", "metadata_forensics", ("incremental_updates_present",), ("medium",), 8),
    ("metadata.incremental_update_multiple", "metadata_forensics", ("incremental_updates_present",), ("high",), 20),
    ("metadata.history_tool_anomaly", "metadata_forensics", ("history_editing_tool_anomaly",), None, 12),
    ("metadata.history_scanned_doc_edited", "metadata_forensics", ("history_scanned_document_edited",), None, 15),
    ("metadata.editable_text_over_scan", "metadata_forensics", ("editable_text_over_scan",), NOTABLE, 10),
    ("metadata.producer_scrubbed", "metadata_forensics", ("producer_scrubbed",), None, 10),
    ("metadata.history_edit_after_final", "metadata_forensics", ("history_edit_after_final_date",), None, 22),
    ("metadata.history_shorter_than_revisions", "metadata_forensics", ("history_shorter_than_revisions",), None, 8),
    ("metadata.history_absent_despite_revisions", "metadata_forensics", ("history_absent_despite_revisions",), None, 8),
    ("metadata.orphaned_objects", "metadata_forensics", ("orphaned_objects",), NOTABLE, 8),
    ("metadata.javascript_or_openaction", "metadata_forensics", ("javascript_or_openaction",), NOTABLE, 10),
    ("metadata.web_page_origin", "metadata_forensics", ("web_page_origin",), NOTABLE, 10),
    ("ela.tamper_region_detected", "error_level_analysis", ("recompression_error_region",), None, 25),
    ("ela.anti_forensic_signal", "error_level_analysis", ("anti_forensic_signal",), None, 30),
    ("copy_move.cluster_detected", "copy_move_detection", ("copy_move_cluster",), None, 35),
    ("font.inconsistency", "font_consistency", ("font_inconsistency", "font_size_inconsistency", "font_subset_split"), ("high",), 40),
    ("font.inconsistency_scanned", "font_consistency", ("font_inconsistency",), ("medium",), 25),
    ("content.deleted_ghost_block", "ghost_content", ("ghost_deleted_block",), ("high",), 25),
    ("content.replaced_ghost_line", "ghost_content", ("ghost_replaced_line",), NOTABLE, 10),
    ("visual.font_inconsistency", "visual_inconsistency_review", ("visual_font_consistency",), NOTABLE, 12),
    ("visual.alignment_inconsistency", "visual_inconsistency_review", ("visual_text_alignment",), NOTABLE, 10),
    ("visual.color_contrast_inconsistency", "visual_inconsistency_review", ("visual_color_contrast_consistency",), NOTABLE, 12),
    ("visual.sharpness_inconsistency", "visual_inconsistency_review", ("visual_resolution_sharpness_consistency",), NOTABLE, 10),
    ("visual.lighting_inconsistency", "visual_inconsistency_review", ("visual_shadow_lighting_consistency",), NOTABLE, 8),
    ("ai.generated_content_suspected", "visual_inconsistency_review", ("ai_generation_assessment",), NOTABLE, 6),
    ("duplicate.cross_case_match", "duplicate_detection", ("near_duplicate_page",), None, 40),
)
#: Rules over flagged checks of printed fields: rule, check, weight.
FIELD_RULES = (
    ("field.date_in_future", "date_in_future", 25),
    ("field.subtotal_line_item_mismatch", "subtotal_line_item_consistency", 15),
    ("field.total_tax_mismatch", "total_tax_consistency", 20),
    ("field.line_item_arithmetic_mismatch", "line_item_arithmetic", 25),
    ("field.tax_rate_mismatch", "tax_rate_consistency", 15),
    ("field.amount_in_words_mismatch", "amount_in_words_consistency", 25),
    ("field.iban_trn_validation", "iban_trn_validation", 15),
    ("metadata.rescan_conflict", "rescan_conflict", 10),
    ("metadata.document_date_after_file_creation", "document_date_vs_file_creation", 25),
    ("field.installment_sum_mismatch", "installment_consistency", 15),
    ("field.date_sequence_inconsistent", "date_sequence", 15),
    ("field.fake_scan_watermark", "fake_scan_watermark", 25),
    ("signature.synthetic_stamp", "stamp_authenticity", 25),
    ("signature.synthetic_stamp_unsigned", "synthetic_stamp_unsigned", 5),
    ("field.tax_invoice_without_trn", "tax_invoice_trn", 15),
    ("field.multiple_invoices_same_period", "multiple_invoices", 10),
    ("field.per_invoice_mismatch", "per_invoice_checks", 15),
    ("field.period_quantity_mismatch", "period_quantity_consistency", 10),
    ("field.reference_number_malformed", "reference_number_format", 6),
    ("signature.stamp_issuer_mismatch", "stamp_issuer_consistency", 15),
)
#: Rules over the result of a whole check: rule, check type, weight.
RESULT_RULES = (
    ("issuer.not_in_registry", "issuer_verification", 15),
    ("signature.expected_missing", "signature_stamp_detection", 10),
)
#: Rules over conflicts between the documents of a case: rule, field, severities, weight.
CONFLICT_RULES = (
    ("identity.name_different_person", "full_name", ("critical",), 60),
    ("identity.name_possible_error", "full_name", ("medium",), 15),
    ("identity.parent_name_different", "parent_or_spouse_name", ("critical",), 40),
    ("identity.parent_name_possible_error", "parent_or_spouse_name", ("medium",), 10),
    ("identity.dob_year_mismatch", "date_of_birth", ("high",), 45),
    ("identity.dob_minor_mismatch", "date_of_birth", ("medium",), 15),
    ("identity.gender_mismatch", "gender", ("high",), 40),
    ("identity.address_mismatch", "address", ("medium",), 15),
    ("identity.income_far_apart", "annual_income", ("critical",), 40),
    ("identity.income_apart", "annual_income", ("high",), 25),
    ("identity.id_number_mismatch", "id_number", ("high",), 40),
    ("identity.photo_different_person", "photo", ("critical",), 60),
    ("identity.photo_uncertain", "photo", ("medium",), 20),
    ("identity.signature_mismatch", "signature", ("high",), 35),
    ("identity.signature_uncertain", "signature", ("medium",), 12),
    ("cross_doc.amount_mismatch", "amount", NOTABLE, 35),
    ("cross_doc.date_mismatch", "date", NOTABLE, 12),
    ("cross_doc.issuer_mismatch", "issuer", NOTABLE, 15),
)
#: Rules over a comparison of signatures: rule, result, weight.
SIGNATURE_RULES = (
    ("signature.inconsistent_with_reference", "inconsistent", 25),
    ("signature.possibly_consistent_only", "possibly_consistent", 5),
    ("signature.identical_reuse", "identical_reuse", 15),
    ("signature.reused_different_signer", "reused_different_signer", 35),
)

SCHEMA = "rule_id STRING, kind STRING, check_type STRING, names ARRAY<STRING>, severities ARRAY<STRING>, weight DOUBLE, is_active BOOLEAN"


def rule_rows() -> list[tuple]:
    """All built-in rules as rows of ``SCHEMA``, active ones all of them."""
    rows = [(r, "finding", c, n, s, w) for r, c, n, s, w in FINDING_RULES]
    rows += [(r, "sub_check", "field_validation", (n,), None, w) for r, n, w in FIELD_RULES]
    rows += [(r, "check_result", c, ("flag",), None, w) for r, c, w in RESULT_RULES]
    rows += [(r, "cross_document", None, (n,), s, w) for r, n, s, w in CONFLICT_RULES]
    rows += [(r, "signature_match", None, (n,), None, w) for r, n, w in SIGNATURE_RULES]
    return [(r, k, c, list(n), list(s) if s else None, float(w), True) for r, k, c, n, s, w in rows]


def rule_pack(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), SCHEMA)
