"""quillguard: policy decisions, redaction and spend accounting over tables and streams of text."""
