"""Evidence: pins, their verification, timelines, redaction, reports and bundles."""
