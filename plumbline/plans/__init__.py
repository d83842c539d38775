"""Work on whole models and whole analyses."""
