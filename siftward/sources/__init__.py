"""Reading and writing: schemas, typed loads, name lists and sinks."""
