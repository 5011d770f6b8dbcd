"""Column functions: Column -> Column, JVM-side unless a module says otherwise."""
