"""Column expressions: row helpers, text extraction and JSON reading."""
