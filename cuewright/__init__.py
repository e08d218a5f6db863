"""Set-at-a-time Spark operators for transcripts, captions, media signals, asset catalogues
and social-post exports."""
