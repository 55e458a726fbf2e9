"""Tables from files, archives, documents and reports, and documents from tables."""
