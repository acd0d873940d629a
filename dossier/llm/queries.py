"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from dossier.llm import filter_audit, licenses, quotes
from dossier.llm.decontaminate import op7_decontamination
from dossier.llm.filter_audit import op11_filter_audit
from dossier.llm.licenses import op8_license_scan
from dossier.llm.packing import op3_packing
from dossier.llm.pii import op10_pii
from dossier.llm.quality import op1_quality
from dossier.llm.quality_rules import op9_quality_rules
from dossier.llm.quotes import op4_quotation_linking
from dossier.llm.secret_scan import op6_secrets
from dossier.llm.simhash import op5_simhash
from dossier.llm.toxicity import op13_toxicity
from dossier.llm.url_filter import op2_url_filter
from dossier.llm.whitening import op12_whitening

QUERIES = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_quotation_linking": op4_quotation_linking,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op4_quotation_linking": quotes.SQL, "op8_license_scan": licenses.sql(), "op11_filter_audit": filter_audit.SQL}
