"""Plans built of the operators: views, publishing, the engine."""
