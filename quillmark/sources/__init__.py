"""Sources and sinks: PDF pages, images, cached extractions and reports."""
