"""Reading and writing document files: objects, filters, fonts, page text."""
