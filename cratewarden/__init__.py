"""Package vetting on Spark: file trees, SBOMs, licenses, vulnerabilities, contacts, over many packages at once."""
