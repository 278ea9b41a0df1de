from notewise.sources.io import (  # noqa: F401
    METRICS_SCHEMA, NOTE_CSV_COLUMNS, land_notes, scan_embeddings, scan_notes,
    scan_notes_csv, write_embeddings, write_metrics, write_table,
)
from notewise.sources.tables import (  # noqa: F401
    conversation_notes, document_notes, embedding_rows, event_rows, label_rows,
    scored_rows, table,
)
