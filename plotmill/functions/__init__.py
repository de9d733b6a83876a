"""Pure Column builders."""
